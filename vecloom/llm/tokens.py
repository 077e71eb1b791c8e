"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton of the vocabulary enumerates every piece that occurs in a word, by its end; dynamic
programming over the ends carries the best score and the number of pieces, and builds no pieces. The
rules are those of the ``tokenizers`` library's Unigram model with a metaspace pre-tokenizer: spaces become a mark that
begins each word; scores add up in double precision; of paths with the same score the one whose last piece
is longest wins; a character that is no piece costs the lowest score less 10 and, with byte fallback,
counts one piece for each of its bytes.

The vocabulary is read from a model file whose path is a parameter. A model that was made by merging carries ranks, not
probabilities; its piece of rank r gets the score -ln(r + 1), Zipf's law.
"""

from __future__ import annotations

import hashlib
import importlib.util
import math
import os
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"
#: Words whose counts a worker remembers.
MEMORY = 600_000
#: Words longer than this are counted with the last ends only.
LONG = 4096


def tokenizer_path(name: str) -> str:
    """A vocabulary file beside the installed package of public tokenizers."""
    found = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if any(model.get_score(i) != round(model.get_score(i)) for i in range(size)):
        return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(size)]
    return [(model.id_to_piece(i), -math.log(i + 1.0)) for i in range(size)]


class Counts(dict):
    """Number of pieces by word (without its mark); a word that is missing is computed. ``of_text`` sums a text."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.ring = max((len(p) for p, _ in vocabulary), default=0) + 2
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocabulary}

    def count(self, word: str) -> int:
        n = len(word)
        if n > LONG:
            return self._count_long(word)
        low = float("-inf")
        best, pieces = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(word):
            for last, (length, score) in self.automaton.iter(word):
                end = last + 1
                start = end - length
                total = score + best[start]
                if total > best[end]:
                    best[end] = total
                    pieces[end] = pieces[start] + 1
            return pieces[n]
        # Some character is no piece: its edge comes after the longer pieces with the same end.
        done, fused = 0, [False] * (n + 1)

        def unknowns(upto: int) -> None:
            nonlocal done
            while done < upto:
                c = word[done]
                done += 1
                if c not in self.single:
                    total = self.unknown + best[done - 1]
                    if total > best[done]:
                        best[done] = total
                        more = len(c.encode("utf-8", "replace")) if self.bytes else 1 - fused[done - 1]
                        pieces[done], fused[done] = pieces[done - 1] + more, True

        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            unknowns(last)
            total = score + best[end - length]
            if total > best[end]:
                best[end] = total
                pieces[end], fused[end] = pieces[end - length] + 1, False
        unknowns(n)
        return pieces[n]

    def _count_long(self, word: str) -> int:
        """``count`` with scores and counts of the ``ring`` last ends only, more than the longest piece has characters."""
        n, ring = len(word), self.ring
        low = float("-inf")
        best, pieces = [low] * ring, [0] * ring
        best[0], at = 0.0, 0  # ``at``: the last end whose place in the ring is its own
        if self.single.issuperset(word):
            for last, (length, score) in self.automaton.iter(word):
                end = last + 1
                if end > at:  # every character is a piece, so no end is passed over
                    best[end % ring], at = low, end
                start = (end - length) % ring
                total = score + best[start]
                if total > best[end % ring]:
                    best[end % ring] = total
                    pieces[end % ring] = pieces[start] + 1
            return pieces[n % ring]
        # Some character is no piece: its edge comes after the longer pieces with the same end.
        fused = [False] * ring

        def unknowns(upto: int) -> None:
            nonlocal done
            while done < upto:
                c = word[done]
                done += 1
                begin(done)
                if c not in self.single:
                    now, before = done % ring, (done - 1) % ring
                    total = self.unknown + best[before]
                    if total > best[now]:
                        best[now] = total
                        more = len(c.encode("utf-8", "replace")) if self.bytes else 1 - fused[before]
                        pieces[now], fused[now] = pieces[before] + more, True

        def begin(end: int) -> None:
            nonlocal at
            if end > at:
                best[end % ring], pieces[end % ring], fused[end % ring], at = low, 0, False, end

        done = 0
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            unknowns(last)
            begin(end)
            now, start = end % ring, (end - length) % ring
            total = score + best[start]
            if total > best[now]:
                best[now] = total
                pieces[now], fused[now] = pieces[start] + 1, False
        unknowns(n)
        return pieces[n % ring]

    def __missing__(self, word: str) -> int:
        value = self.count(MARK + word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(" ", MARK).split(MARK)
        if not words[0]:  # a text that begins with the mark gets no other
            del words[0]
        if len(self) > MEMORY:
            self.clear()
        return sum(map(self.__getitem__, words))


#: The automaton a worker keeps, by a digest of the whole vocabulary.
_COUNTS: dict[bytes, Counts] = {}


def vocabulary_key(vocabulary: list[tuple[str, float]]) -> bytes:
    """A digest of every piece and score, in their order."""
    h = hashlib.sha256()
    for piece, score in vocabulary:
        raw = piece.encode("utf-8", "surrogatepass")
        h.update(struct.pack("<qd", len(raw), score))
        h.update(raw)
    return h.digest()


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | str | None = None) -> DataFrame:
    """One row for each document: (doc_id, tokens). ``vocabulary``: pieces with scores, or a model's path.

    A null text has null tokens, an empty one 0, and an empty table gives no rows. No shuffle; equal rows get equal counts; extra columns
    aren't read. A word of any length, such as a long text without spaces, is counted piece by piece of the text: the programming
    keeps scores and counts of the last characters only, as many as the longest piece has.
    """
    if vocabulary is None or isinstance(vocabulary, str):
        vocabulary = read_vocabulary(vocabulary or tokenizer_path(MODEL))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # its size doesn't depend on the data
    key = vocabulary_key(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[key] = Counts(sent.value)
        counts = _COUNTS[key]
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([None if t is None else counts.of_text(t) for t in texts], pa.int64())], ["doc_id", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long")


ORACLE_SQL = None  # a tokenizer: tests/llm/test_tokens.py compares it with the tokenizers library


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
