from collections import Counter

import corpus_pipeline
import pytest
from test_mixing import simulated
from test_packing import check_bins
from test_simhash import brute as near_duplicates
from test_substring import brute as cut

from vecloom.llm import langid, mixing, packing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows after each stage, each written and read again."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], folder).write.parquet(f"{folder}/stage{k}")
        out.append(spark.read.parquet(f"{folder}/stage{k}"))
    return [[tuple(r) for r in df.collect()] for df in out], [df.columns for df in out]


def test_columns(stages):
    assert all(c == COLUMNS for c in stages[1][:-1])


def test_language_id(spark, folder, stages):
    """Each text labelled alone, on the driver."""
    model = langid.fit(spark.read.parquet(f"{folder}/documents.parquet"))

    def keeps(text):
        owner, post = langid.label(model, [text], langid.Scores(model))
        return langid._verdicts(model, 1, owner, post, langid.LEAST_SHARE)[-1][0].as_py()

    rows = stages[0]
    assert Counter(rows[1]) == Counter(r for r in rows[0] if keeps(r[1]))


def test_near_dedup(stages):
    rows = stages[0]
    want = Counter(rows[1])
    for (doc, _), n in near_duplicates(rows[1]).items():
        row = next(r for r in rows[1] if r[0] == doc)
        want[row] -= n
    assert Counter(rows[2]) == +want


def test_near_dedup_joins_no_candidates(spark, folder, stages, monkeypatch):
    """Chance candidates grow with the square of the documents: the stage makes no rows of them."""
    plans, real = [], simhash.near_edges
    monkeypatch.setattr(simhash, "near_edges", lambda *a: plans.append(real(*a)) or plans[-1])
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/stage0"), folder)
    assert plans and all("Join" not in df._jdf.queryExecution().toString() for df in plans)


def test_substring_dedup(stages):
    rows = stages[0]
    rest = {(r[0], r[1]): r[2:4] for r in rows[2]}
    want = []
    for (doc, text, _), before in zip(cut(rows[2]), rows[2]):
        if text and text.strip():
            want.append((doc, text, *rest[(before[0], before[1])], len(text)))
    assert Counter(rows[3]) == Counter(want)


def test_mixture(stages):
    rows = stages[0]
    assert not Counter(rows[4]) - Counter(rows[3])
    counts = Counter(r[3] or "" for r in rows[3])
    slots = simulated({s: -(-n // mixing.BLOCK_DOCS) for s, n in counts.items()}, mixing.target_weights(counts), mixing.QUANTUM, mixing.LEAST_LIVE)
    blocks = Counter(s for s, _ in slots.values())
    for s, n in counts.items():
        assert Counter(r[3] or "" for r in rows[4])[s] == min(n, blocks[s] * mixing.BLOCK_DOCS)


def test_packing(stages, spark, folder):
    rows, columns = stages
    bins = [dict(zip(columns[5], r)) for r in rows[5]]
    check_bins(bins, [(r[0], r[1]) for r in rows[4]], packing.CAPACITY)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(rows[5])


def test_bins_follow_the_mixture(stages, spark, folder, monkeypatch, tmp_path):
    """Read one after another, the bins hold run after run of the mixture; another order of it gives other bins."""
    order = [r[0] for r in spark.read.parquet(f"{folder}/stage3").orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    monkeypatch.setattr(packing.pack_in_order, "__defaults__", (packing.CAPACITY, "tokens", 8))
    got = sorted(tuple(r) for r in corpus_pipeline.packed(spark, spark.read.parquet(f"{folder}/stage3"), folder).select("bin_id", "doc_id").collect() if r[1] is not None)
    runs = [order.index(doc) // 8 for _, doc in got]
    assert runs == sorted(runs) and runs[-1] > 3
    spark.read.parquet(f"{folder}/stage3").coalesce(1).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/other")
    other = [tuple(r) for r in corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/other"), folder).select("bin_id", "doc_id").collect()]
    assert Counter(d for _, d in other if d is not None) == Counter(d for _, d in got) and set(other) != set(got)


def test_empty(spark, empty, tmp_path):
    empty.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
