"""Connected components by brute force."""


def groups(keys, near):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}
