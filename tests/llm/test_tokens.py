import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from vecloom.llm import tokens


def library(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.read_vocabulary(tokens.tokenizer_path(tokens.MODEL))


@pytest.mark.parametrize("long", [0, 4096])
def test_random_vocabularies_with_ties(monkeypatch, long):
    monkeypatch.setattr(tokens, "LONG", long)
    rng = random.Random(0)
    for _ in range(400):
        v = {"<unk>": 0.0}
        for _ in range(rng.randint(1, 12)):
            v.setdefault("".join(rng.choice("abc" + tokens.MARK) for _ in range(rng.randint(1, 4))), -float(rng.randint(1, 4)))
        want, got = library(list(v.items()), False), tokens.Counts(list(v.items()))
        for _ in range(8):
            s = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
            assert got.of_text(s) == want(s), (v, s)


def test_public_vocabulary(vocabulary, rows):
    want, got = library(vocabulary, True), tokens.Counts(vocabulary)
    for s in [r[1] for r in rows if r[1] is not None] + ["", " ", "  a", "▁x", "日本語 テスト", "\n\n", "<0x41>", "🙂🙂 x", "\t", "a" * 5000]:
        assert got.of_text(s) == want(s)


def test_query(docs, rows, vocabulary):
    want = library(vocabulary, True)
    got = sorted((tuple(r) for r in tokens.count_tokens(docs).collect()), key=repr)
    assert got == sorted(((r[0], None if r[1] is None else want(r[1])) for r in rows), key=repr)


def test_two_vocabularies_in_one_worker(spark):
    """Vocabularies that differ in few of many entries have counts of their own."""
    base = [("<unk>", 0.0), *[(f"piece{i}", -5.0) for i in range(3000)], *[(c, -9.0) for c in "abcdefghijklmnopqrstuvwxyz" + tokens.MARK]]
    other = list(base)
    other[77] = (tokens.MARK + "hello", -1.0)
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string").coalesce(1)
    got = [tokens.count_tokens(df, v).first()["tokens"] for v in (base, other, base)]
    assert got == [library(v, False)("hello world") for v in (base, other, base)] and got[0] != got[1]


def test_long_text_without_spaces(monkeypatch):
    """The ring of last ends is as long as the longest piece needs."""
    monkeypatch.setattr(tokens, "LONG", 100)
    v = [("<unk>", 0.0), (tokens.MARK, -2.0), ("a", -2.0), ("ab", -3.0), ("bab", -3.5), ("b", -2.5), ("abba", -4.0)]
    rng = random.Random(3)
    for alphabet in ("ab", "abc"):
        s = "".join(rng.choice(alphabet) for _ in range(30_000))
        assert tokens.Counts(v).of_text(s) == library(v, False)(s)


def test_empty(empty):
    assert tokens.count_tokens(empty).count() == 0
