"""Substring dedup by sliding sentence spans.

A text is cut into sentences that add up to the whole text. From every sentence on, the
shortest run of at least ``SENTENCES`` sentences with at least ``CHARS`` characters is a span; its
hash is joined with those of the whole corpus. Of equal spans the one with the least
(doc_id, text key, position) is the first; every sentence that any other covers is removed.

A repeated passage may end in sentences too short for a span of their own. With ``every`` the shortest run back from every
sentence end is a span too; as the two lie side by side in any longer run, every sentence that a repeat of a run of any length
covers is removed. A passage may also lie in one long sentence or in parts of two: every run of ``WORDS`` words that holds no span
of sentences between its first sentence end and its last is a span too, of which the words are removed. So no run of ``WORDS`` words
stays twice, except where line breaks part it differently. Sentences of other scripts end at their own marks. The pipeline and
``op5_substring_dedup_every_run`` do all that; the SQL of ``op5_substring_dedup`` has only the shortest runs from each start.

The hash of a run combines hashes of its sentences (lower case, without the white space at
the end) as a polynomial in their positions, so that all runs of a text cost one pass. It has 96 bits, of two polynomials, as a chance
collision would cut a text: with 3e12 spans (100 TB) one is expected once in 2e4 such corpora.

Only the first of equal spans in a batch of documents can be the first of all; the others are repeats without any join. So a passage
that very many documents share sends a span for each batch, not for each document, to the task that orders its occurrences. Spans
travel packed, 19 bytes each, by ranges of the hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import Scratch, release_memory, slices, text_key

SENTENCES, CHARS, WORDS = 2, 40, 50
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+\Z")
SENTENCE_ANY = re.compile(SENTENCE.pattern.replace(".!?", ".!?。！？｡．؟۔।॥።"))
SENTENCE_END = re.compile(r"[.!?\n。！？｡．؟۔।॥።][ \t\r\n]*\Z")
#: Scripts without spaces between words: each of their characters counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"\s*(?:[{UNSPACED}]|[^\s{UNSPACED}]+)\s*")
#: A place has so many bits, enough for any text; those from WORD_PLACES on are of runs of words.
PLACE_BITS = 36
WORD_PLACES = 1 << (PLACE_BITS - 1)
#: Two hashes of a run, of 64 and of 32 bits, have bases of their own.
BASES = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def sentences(text: str, every: bool = False) -> list[str]:
    """Pieces that end with . ! ? or a line break and the white space after them; joined they are the text. ``every``: also at other scripts' marks."""
    return (SENTENCE_ANY if every else SENTENCE).findall(text)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out[:n]


def _digests(items: Iterable[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string."""
    raw = b"".join([xxhash.xxh3_128_digest(s.encode("utf-8", "replace")) for s in items])
    both = np.frombuffer(raw, ">u8").reshape(n, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _run_hashes(digests: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 32 bits) of the runs from ``start`` up to ``end``."""
    out = []
    with np.errstate(over="ignore"):
        for digest, base, inverse in zip(digests, BASES, INVERSES):
            n = len(digest)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest * _powers(base, n), dtype=np.uint64)])
            out.append((total[end] - total[start]) * _powers(inverse, n)[start])
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spans(texts: list[str], least: int = SENTENCES, chars: int = CHARS, every: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """All spans of the texts: (row, hashes, start, end), the positions counting sentences. ``every``: also the shortest runs back from an end that no start has."""
    found = [[s.rstrip(" \t\r\n").lower() for s in sentences(t, every)] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    n = int(sizes.sum())
    flat = [s for f in found for s in f]
    length = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, n))])
    start = np.arange(n)
    row = np.repeat(np.arange(len(found)), sizes)
    last = np.cumsum(sizes)[row] if n else start
    end = np.maximum(start + least, np.searchsorted(length, length[:-1] + chars))
    fits = end <= last
    if every:
        until = start + 1
        back = np.minimum(until - least, np.searchsorted(length, length[1:] - chars, "right") - 1)
        # The shortest run from the same start, where it ends there too, is the same span.
        more = (back >= (np.cumsum(sizes) - sizes)[row]) & (end[np.maximum(back, 0)] != until) if n else fits
        start, end, row = np.concatenate([start[fits], back[more]]), np.concatenate([end[fits], until[more]]), np.concatenate([row[fits], row[more]])
    else:
        start, end, row = start[fits], end[fits], row[fits]
    first = (np.cumsum(sizes) - sizes)[row] if n else start
    return row, _run_hashes(_digests(flat, n), start, end), start - first, end - first


def word_spans(texts: list[str], least: int = SENTENCES, chars: int = CHARS) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The runs of ``WORDS`` words with no span of whole sentences inside: (row, hashes, start), the positions counting words.

    Whether a run counts follows from its words alone: the sentence it begins in and a last one without a mark are taken for parts.
    """
    found = [sentences(t, True) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    words = [WORD.findall(s) for f in found for s in f]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    n = int(counts.sum())
    if n < WORDS:
        return np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int32)), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])  # the first word of each sentence
    last = np.cumsum(sizes)
    length = np.concatenate([[0], np.cumsum(np.fromiter((len(s.rstrip(" \t\r\n")) for f in found for s in f), np.int64, len(words)))])
    ends = np.arange(len(words) + 1)
    ends = np.minimum(np.maximum(ends + least, np.searchsorted(length, length + chars)), len(words) + 1)
    whole = last - np.fromiter((bool(f) and SENTENCE_END.search(f[-1]) is None for f in found), np.int64, len(found))
    row_of = np.repeat(np.arange(len(found)), sizes)
    # The word with which the first span after each sentence ends.
    after = np.minimum(ends[np.arange(len(words)) + 1], len(words))
    inside = np.where(ends[np.arange(len(words)) + 1] <= whole[row_of], at[after], n + WORDS)
    sentence = np.repeat(np.arange(len(words)), counts)
    row, start = row_of[sentence], np.arange(n)
    fits = (start + WORDS <= at[last][row]) & (start + WORDS < inside[sentence])
    start, row = start[fits], row[fits]
    code, more = _run_hashes(_digests((x.strip().lower() for w in words for x in w), n), start, start + WORDS)
    # Turned over, so that it isn't the hash of sentences that are one word each.
    return row, (~code, more), start - at[last - sizes][row]


TAG_BITS = 63 - PLACE_BITS


def _names() -> tuple[Column, Column]:
    """What a span row knows of its document: its id, or the text's key where that is null; and a tag of 28 bits, negative for
    null ids, that tells texts of one id apart (two texts of one id share it once in 2 ** 27)."""
    key = text_key(F.col("text"))
    low = key.bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    doc = F.col("doc_id").cast("long")
    return F.coalesce(doc, key), F.when(doc.isNull(), low - (1 << TAG_BITS)).otherwise(low)


def _places(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What tells the spans of a text apart: 2 * start for the shortest run from a start, 2 * end - 1 for one that is only the shortest back from
    its end. Of equal spans the order is that of the starts. The other end follows, so it isn't carried."""
    key = (row << 32) + start
    order = np.lexsort((end, key))
    # ``spans`` has every shortest run from a start, so of two spans of one start the longer is of the other kind.
    longer = np.zeros(len(key), bool)
    longer[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.where(longer, 2 * end - 1, 2 * start)


def _settled(code: np.ndarray, more: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sure): the spans of a batch sorted by hash and rank; sure are those that a span of another place comes before."""
    order = np.argsort(code, kind="stable")
    equal = code[order[1:]] == code[order[:-1]]
    shared = np.flatnonzero(np.append(equal, False) | np.append(False, equal)) if len(order) else order
    some = order[shared]
    order[shared] = some[np.lexsort((at[some], doc[some], at[some] < 0, more[some], code[some]))]
    code, more, doc, at = code[order], more[order], doc[order], at[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (more[1:] != more[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0)) if len(code) else np.zeros(0, np.int64)
    return order, (doc != doc[first]) | (at != at[first])


#: A span in the shuffle: its hashes, which of the batch's documents it is in, and its place in two parts. A settled one needs no hashes.
SPAN = np.dtype([("hash", "<i8"), ("more", "<i4"), ("doc", "<u2"), ("low", "<u4"), ("high", "u1")])
SETTLED = np.dtype([("doc", "<u2"), ("low", "<u4"), ("high", "u1")])
NAME = np.dtype([("doc", "<i8"), ("tag", "<i4")])
#: Bytes of text whose spans one task orders, and that are packed together (of at most BATCH_DOCS documents). Packing pays while a batch has
#: several spans for each bucket, up to about a terabyte with these; with the memory of larger executors both can be as much larger.
BUCKET_BYTES, BATCH_BYTES, BATCH_DOCS = 8 << 20, 4_000_000, 50_000


def _places_into(out: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    out["doc"], out["low"], out["high"] = row, place & 0xFFFFFFFF, place >> 32
    return out


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (((code.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _packed(batch: pa.RecordBatch, buckets: int, least: int, chars: int, every: bool) -> pa.RecordBatch:
    """The spans of one batch of (doc, tag, text), packed by bucket."""
    done = 0
    names = np.zeros(batch.num_rows, NAME)
    names["doc"], names["tag"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for piece in slices(batch, "text"):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        row, (code, more), start, end = spans(texts, least, chars, every)
        found.append((code, more, row + done, _places(row, start, end)))
        if every:
            row, (code, more), start = word_spans(texts, least, chars)
            found.append((code, more, row + done, start + WORD_PLACES))
        done += len(texts)
    code, more, row, place = (np.concatenate(x) for x in zip(*found))
    doc, at = names["doc"][row], (names["tag"][row].astype(np.int64) << PLACE_BITS) + place
    order, sure = _settled(code, more, doc, at)
    code, more, row, place, doc, at = code[order], more[order], row[order], place[order], doc[order], at[order]
    stay = np.ones(len(code), bool)
    stay[1:] = (code[1:] != code[:-1]) | (more[1:] != more[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    open_, sure = np.flatnonzero(stay & ~sure), np.flatnonzero(stay & sure)
    packed = _places_into(np.zeros(len(open_), SPAN), row[open_], place[open_])
    packed["hash"], packed["more"] = code[open_], more[open_]
    settled = _places_into(np.zeros(len(sure), SETTLED), row[sure], place[sure])
    with np.errstate(over="ignore"):
        parts = [(x, np.argsort(b, kind="stable"), b) for x, b in ((packed, _bucket(code[open_], buckets)), (settled, _bucket(doc[sure] * np.int64(-7046029254386353131), buckets)))]
    (packed, first, b), (settled, second, c) = parts
    packed, settled, b, c = packed[first], settled[second], b[first], c[second]
    out = []
    for k in np.unique(np.concatenate([b, c])):
        some, rest = (x[slice(*np.searchsorted(y, [k, k + 1]))].copy() for x, y in ((packed, b), (settled, c)))
        used = np.unique(np.concatenate([some["doc"], rest["doc"]]))
        some["doc"], rest["doc"] = np.searchsorted(used, some["doc"]), np.searchsorted(used, rest["doc"])
        out.append((k, names[used].tobytes(), some.tobytes(), rest.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "names", "spans", "settled"])


def packed_spans(docs: DataFrame, buckets: int, least: int = SENTENCES, chars: int = CHARS, every: bool = False) -> DataFrame:
    """(bucket, names, spans, settled): the spans of a batch of documents by the bucket of their hash, packed.

    ``settled`` are repeats of a span of their own batch; they take no part in any comparison and go to the bucket of their document.
    Of equal rows of a batch one stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in slices(whole, "text", BATCH_BYTES):
                for a in range(0, some.num_rows, BATCH_DOCS):
                    yield _packed(some.slice(a, BATCH_DOCS), buckets, least, chars, every)
        release_memory()

    doc, tag = _names()
    return docs.select(doc.alias("doc"), tag.alias("tag"), "text").mapInArrow(run, "bucket long, names binary, spans binary, settled binary")


def unpacked(table: pa.Table) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(hash, more, doc, at) of the spans and (doc, at) of the settled ones of packed rows."""
    open_, done = [[np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]], [[np.zeros(0, np.int64), np.zeros(0, np.int64)]]
    for names, some, rest in zip(*(table.column(c).to_pylist() for c in ("names", "spans", "settled"))):
        names = np.frombuffer(names, NAME)
        for raw, kind, out in ((some, SPAN, open_), (rest, SETTLED, done)):
            x = np.frombuffer(raw, kind)
            at = (names["tag"][x["doc"]].astype(np.int64) << PLACE_BITS) + (x["high"].astype(np.int64) << 32) + x["low"]
            out.append([*([x["hash"], x["more"]] if kind is SPAN else []), names["doc"][x["doc"]], at])
    return tuple(np.concatenate(x) for x in zip(*open_)), tuple(np.concatenate(x) for x in zip(*done))


def repeated_spans(docs: DataFrame, least: int = SENTENCES, chars: int = CHARS, every: bool = False) -> DataFrame:
    """The spans that aren't the first of their kind: (doc, tag, places). One shuffle, by hash; a task orders the spans of about ``BUCKET_BYTES`` of text.

    Equal rows (same doc_id and text) count as one document, so none of them is a repeat of another. So do rows of equal texts
    whose doc_id is null, as nothing tells them apart.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packed = packed_spans(docs, -(-size // BUCKET_BYTES) or 1, least, chars, every)

    def each(table: pa.Table) -> pa.Table:
        (code, more, doc, at), (settled_doc, settled_at) = unpacked(table)
        order, later = _settled(code, more, doc, at)
        repeated = order[later]
        doc, at = np.concatenate([doc[repeated], settled_doc]), np.concatenate([at[repeated], settled_at])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        tag = at >> PLACE_BITS
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        first = np.flatnonzero(new)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(at & ((1 << PLACE_BITS) - 1)))
        out = pa.table({"doc": doc[first], "tag": tag[first], "places": places})
        release_memory()
        return out

    return packed.groupBy("bucket").applyInArrow(each, "doc long, tag long, places array<long>")


def _without(pieces: list[str], rest: list[str], starts: np.ndarray) -> None:
    """Takes the words that the runs at ``starts`` cover out of ``rest``."""
    split = [WORD.findall(p) for p in pieces]
    change = np.zeros(sum(map(len, split)) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WORDS, -1)
    stay, at = np.cumsum(change)[:-1] == 0, 0
    for i, w in enumerate(split):
        if rest[i] and w:
            rest[i] = "".join([x for x, s in zip(w, stay[at : at + len(w)]) if s])
        at += len(w)


def _cutter(least: int, chars: int, every: bool):
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())]))
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, places):
            if text is None or at is None:
                out.append((None, None))
                continue
            pieces = sentences(text, every)
            at = np.asarray(at, np.int64)
            row, _, start, end = spans([text], least, chars, every)
            change = np.zeros(len(pieces) + 1, np.int64)
            hit = np.isin(_places(row, start, end), at)
            np.add.at(change, start[hit], 1)
            np.add.at(change, end[hit], -1)
            stay = np.cumsum(change)[:-1] == 0
            rest = [p if s else "" for p, s in zip(pieces, stay)]
            if len(words := at[at >= WORD_PLACES] - WORD_PLACES):
                _without(pieces, rest, words)
            out.append(("".join(rest), sum(r != p for r, p in zip(rest, pieces))))
        return pd.DataFrame(out, columns=["text", "gone"])

    return cut


def drop_repeated_spans(docs: DataFrame, least: int = SENTENCES, chars: int = CHARS, gone: str | None = None, every: bool = False) -> DataFrame:
    """``docs`` with the repeated sentences cut out of ``text``; rows and other columns stay, whatever their names.

    Null texts stay null, empty ones empty, and an empty table empty; a text whose sentences are all repeats becomes empty. Texts
    too short for a span are never cut; very long ones are read whole, each in one task. ``gone`` names a column to add: the number of sentences removed in whole or in part.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    found = repeated_spans(docs, least, chars, every).groupBy("doc", "tag")
    cut = scratch.write(found.agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("__vl_at")), "cut")  # a row holds places of one text
    cut = cut.withColumnsRenamed({"doc": "__vl_doc", "tag": "__vl_tag"})
    doc, tag = _names()
    out = docs.join(cut, (doc == F.col("__vl_doc")) & (tag == F.col("__vl_tag")), "left")
    out = out.withColumn("__vl_new", _cutter(least, chars, every)(F.when(F.col("__vl_at").isNotNull(), F.col("text")), F.col("__vl_at")))
    text = F.when(F.col("__vl_at").isNull(), F.col("text")).otherwise(F.col("__vl_new.text")).alias("text")
    more = [] if gone is None else [F.coalesce("__vl_new.gone", F.lit(0)).cast("long").alias(gone)]
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != gone], *more)


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, i, s, lower(rtrim(s, ' ' || chr(9) || chr(10) || chr(13))) AS low
  FROM (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+\z') AS ss FROM documents))
), summed AS (
  SELECT *, sum(length(low)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM pieces
), ends AS (
  SELECT a.doc_id, a.i, min(b.i) AS j
  FROM summed a JOIN (SELECT unnest(range({SENTENCES - 1}, {CHARS + 2})) AS d) d ON true
  JOIN summed b ON b.doc_id = a.doc_id AND b.i = a.i + d.d AND b.upto - a.upto + length(a.low) >= {CHARS}
  GROUP BY ALL
), runs AS (
  SELECT e.doc_id, e.i, e.j, string_agg(p.low, chr(1) ORDER BY p.i) AS run
  FROM ends e JOIN pieces p ON p.doc_id = e.doc_id AND p.i BETWEEN e.i AND e.j GROUP BY ALL
), later AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later
), kept AS (
  SELECT p.doc_id, string_agg(p.s, '' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS text, count(c.i) AS removed_sentences
  FROM pieces p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text, coalesce(k.removed_sentences, 0) AS removed_sentences
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_spans(docs, gone="removed_sentences")


def query_every_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_spans(docs, gone="removed_sentences", every=True)
