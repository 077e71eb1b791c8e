import os
import random

from vecloom.llm import repetition


def brute(t, least):
    covered, best = set(), 0
    for i in range(len(t)):
        longest = 0
        for j in range(len(t)):
            k = 0
            while i != j and i + k < len(t) and j + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            longest = max(longest, k)
        if longest >= least:
            best = max(best, longest)
            covered.update(range(i, i + longest))
    return len(covered), best


def repeats(t, least):
    """The same by sorting all suffixes as strings: the longest repeat of a place is shared with a neighbour in that order."""
    order = sorted(range(len(t)), key=lambda i: t[i:])
    longest = [0] * len(t)
    for i, j in zip(order, order[1:]):
        k = len(os.path.commonprefix([t[i:], t[j:]]))
        longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    covered = {x for i, k in enumerate(longest) if k >= least for x in range(i, i + k)}
    return len(covered), max([k for k in longest if k >= least], default=0)


def test_against_all_pairs():
    rng = random.Random(1)
    for _ in range(250):
        alphabet, least = rng.choice([1, 2, 3, 30, 5000]), rng.choice([1, 2, 3, 5, 8, 9, 20])
        t = "".join(chr(97 + rng.randrange(alphabet)) for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.5 and len(t) > 5:
            t = t + t[: rng.randint(1, len(t))] + rng.choice(["", "z"]) + t[2:]
        assert repetition.repetition(t, least) == brute(t, least) == repeats(t, least), (t, least)


def test_rules(docs, rows):
    got = {(r["doc_id"], r["chars"]): r for r in repetition.repetition_rules(docs).collect()}
    assert len(got) == len({(r[0], None if r[1] is None else len(r[1])) for r in rows})
    for (doc, chars), r in got.items():
        assert r["keep"] == (doc != 65), r  # only the text of one letter repeats
    assert got[(65, 3000)]["longest_repeat"] == 2999 and got[(65, 3000)]["repeated_fraction"] == 1.0
    assert got[(60, None)]["keep"] and got[(61, 0)]["keep"]


def test_very_long_periodic_text():
    assert repetition.repetition("ab " * 50_000) == (150_000, 149_997)


def test_very_long_text_without_repeats():
    """A third of a million random characters, then with one passage repeated."""
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefghij ") for _ in range(330_000))
    assert repetition.repetition(t, 64) == (0, 0)
    assert repetition.repetition(t + "|" + t[1000:1400], 64) == (800, 400)


def test_empty(empty):
    assert repetition.repetition_rules(empty).count() == 0
