"""The registered queries against their SQL on the whole tables."""

from collections import Counter
from pathlib import Path

import pytest
from compare import assert_same, database
from test_mixing import simulated
from test_packing import check_bins
from test_records import expected
from test_repetition import repeats
from test_tokens import library

from vecloom.llm import langid, mixing, packing, queries, records, repetition, tokens


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), database(sf_dir), queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_op1_whole_table(spark, sf_dir, documents):
    """Every token of every document in one place, no bin too full."""
    check_bins(queries.queries()["op1_best_fit_packing"](spark, sf_dir).collect(), [(i, t) for i, t, _ in documents], packing.CAPACITY)


def test_op2_whole_table(spark, sf_dir, documents):
    count = library(tokens.read_vocabulary(tokens.tokenizer_path(tokens.MODEL)), True)
    got = Counter(tuple(r) for r in queries.queries()["op2_token_counts"](spark, sf_dir).collect())
    assert got == Counter((i, None if t is None else count(t)) for i, t, _ in documents)


def test_op3_whole_table(spark, sf_dir, documents):
    """Slot by slot, with the production parameters."""
    counts = Counter(s or "" for _, _, s in documents)
    want = simulated({s: -(-n // mixing.BLOCK_DOCS) for s, n in counts.items()}, mixing.target_weights(counts), mixing.QUANTUM, mixing.LEAST_LIVE)
    got = queries.queries()["op3_mixing"](spark, sf_dir).collect()
    assert {(r["slot"], r["source"] or "", r["block"]) for r in got} == {(slot, s, b) for slot, (s, b) in want.items()}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in documents)


def test_op7_whole_table(spark, sf_dir, documents):
    """Repeats of the documents of up to 2,500 characters by comparing all pairs of positions, the rules for all."""
    texts = {i: t for i, t, _ in documents}
    for r in queries.queries()["op7_repetition_rules"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        if text and len(text) <= 2500:
            covered, longest = repeats(text, repetition.MIN_REPEAT)
            assert (r["repeated_chars"], r["longest_repeat"]) == (covered, longest)
        long = r["longest_repeat"] > repetition.MOST_REPEAT and r["longest_repeat"] > repetition.MOST_REPEAT_SHARE * (r["chars"] or 0)
        assert r["keep"] == (r["repeated_fraction"] <= repetition.MOST_COVERED and not long)


def test_op9_whole_table(spark, sf_dir, documents):
    """Each text labelled alone; where the table says a language, most are found right."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(table)
    lang = {r["doc_id"]: r["lang"] for r in table.collect()}
    got = {r["doc_id"]: r for r in queries.queries()["op9_language_id"](spark, sf_dir).collect()}
    right = []
    for i, text, _ in documents:
        owner, post = langid.label(model, [text], langid.Scores(model))
        label, share, *_, keep = (x[0].as_py() for x in langid._verdicts(model, 1, owner, post, langid.LEAST_SHARE))
        assert (got[i]["lang"], got[i]["keep"]) == (label, keep) and (share is None or abs(got[i]["share"] - share) < 1e-5)
        if keep:
            right.append(label == lang[i])
    assert sum(right) > 0.9 * len(right) > 0


def test_op10_whole_table(spark, sf_dir, documents):
    """The records that the query wrote are read back, found by its own index."""
    folders = lambda: {p for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("records-*")}
    before = folders()
    index = queries.queries()["op10_token_records"](spark, sf_dir)
    (path,) = folders() - before
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in records.read_records(index, str(path)).collect())
    assert got == expected([(i, t) for i, t, _ in documents])


def test_every_query_has_a_check_of_its_rows():
    """SQL, or a test of this file; the second query of op5 is held against the rule of every run in test_substring."""
    without = set(queries.queries()) - set(queries.oracle_sql()) - {"op5_substring_dedup_every_run"}
    assert without == {f"op{n}_{x}" for n, x in ((1, "best_fit_packing"), (2, "token_counts"), (3, "mixing"), (7, "repetition_rules"), (9, "language_id"), (10, "token_records"))}
