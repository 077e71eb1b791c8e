import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, rest string, component string, block string, slot string, gone string, id string"
WORDS = {
    "en": "the of and house river light morning water with their over under garden letter window".split(),
    "de": "der und nicht haus fluss licht morgen wasser mit ihren über unter garten brief fenster".split(),
    "fr": "le et dans maison rivière lumière matin eau avec leurs jardin lettre fenêtre toujours jamais".split(),
}


def sentence(rng: random.Random, lang: str, n: int = 12) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefghijklmnop") * rng.randint(0, 2) for _ in range(n)).capitalize() + "."


def prose(rng: random.Random, lang: str, sentences: int) -> str:
    return " ".join(sentence(rng, lang, rng.randint(8, 16)) for _ in range(sentences))


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose with copies, near copies, repeated passages, nulls, empties and a very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append([i, prose(rng, lang, rng.randint(3, 12)), lang, f"s{min(i % 7, 3)}"])
    shared = " ".join(sentence(rng, "en", 14) for _ in range(3))
    for i in (5, 17, 33, 48):
        rows[i][1] += " " + shared
    rows[11][1] = rows[3][1]
    rows[21][1] = rows[3][1]
    rows[22][1] = rows[8][1].replace(".", ",", 1) + " End."
    rows.append([n, None, "en", "s0"])
    rows.append([n + 1, "", "en", "s1"])
    rows.append([n + 2, " \n\t ", None, "s1"])
    rows.append([n + 3, prose(rng, "en", 1500), "en", "s2"])
    rows.append([n + 4, prose(rng, "de", 4), None, None])
    rows.append([None, prose(rng, "fr", 4), "fr", "s2"])
    rows.append([n + 5, "x" * 3000, "en", "s2"])
    rows.append(list(rows[0]))
    rows.append(list(rows[0]))
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns that bear names the operators use inside."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g", "h") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
