"""Token-id output as length-delimited binary records.

A record frames one serialized sequence as: length (8 bytes), masked CRC-32C of the length (4 bytes), the bytes,
masked CRC-32C of the bytes (4 bytes), all little-endian. The sequence is the doc_id (8 bytes) and the token ids,
2 bytes each (4 where the vocabulary has more than 65,536 ids). Each task streams one file and a separate index, a
Parquet table of every record's file and offset, allows reads in any order.

A file's name is drawn for each attempt of a task, and the index holds the names of the attempts that
counted: a lost executor or a speculative copy leaves at most a file that no index names, and it is deleted at the end.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import Scratch, slices

RANKS = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 512
MASK = 0xA282EAD8


def _tables() -> np.ndarray:
    """Slicing-by-eight tables of the Castagnoli polynomial."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0x82F63B78), first >> 1)
    out = [first]
    for _ in range(7):
        out.append((out[-1] >> 8) ^ first[out[-1] & 0xFF])
    return np.stack(out)


TABLES = _tables()


def _advance(crc: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The registers after another block of 8 * k bytes each."""
    words = blocks.view(np.uint32)
    for k in range(0, words.shape[1], 2):
        low, high = crc ^ words[:, k], words[:, k + 1]
        crc = (
            TABLES[7][low & 0xFF] ^ TABLES[6][(low >> 8) & 0xFF] ^ TABLES[5][(low >> 16) & 0xFF] ^ TABLES[4][low >> 24]
            ^ TABLES[3][high & 0xFF] ^ TABLES[2][(high >> 8) & 0xFF] ^ TABLES[1][(high >> 16) & 0xFF] ^ TABLES[0][high >> 24]
        )
    return crc


def _shift_tables() -> np.ndarray:
    """What CHUNK zero bytes make of each byte of a register."""
    zero = np.zeros((1024, CHUNK), np.uint8)
    start = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return _advance(start, zero).reshape(4, 256)


SHIFT = _shift_tables()


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of slices of a byte array. All whole chunks advance side by side; chunks of a slice are joined by shifting registers over zeros."""
    whole = sizes // CHUNK
    owner = np.repeat(np.arange(len(sizes)), whole)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    parts = np.zeros(len(owner), np.uint32)
    for a in range(0, len(owner), 4096):
        o = slice(a, a + 4096)
        pick = (starts[owner[o]] + at[o] * CHUNK)[:, None] + np.arange(CHUNK)
        parts[o] = _advance(np.zeros(len(pick), np.uint32), data[pick])
    crc = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-whole, kind="stable")
    first = np.cumsum(whole) - whole
    for k in range(int(whole.max()) if len(whole) else 0):
        rows = order[: np.searchsorted(-whole[order], -k, side="left")]
        c = crc[rows]
        crc[rows] = SHIFT[0][c & 0xFF] ^ SHIFT[1][(c >> 8) & 0xFF] ^ SHIFT[2][(c >> 16) & 0xFF] ^ SHIFT[3][c >> 24] ^ parts[first[rows] + k]
    rest, begin = sizes - whole * CHUNK, starts + whole * CHUNK
    order = np.argsort(-rest, kind="stable")
    for k in range(0, int(rest.max()) if len(rest) else 0, 8):
        rows = order[: np.searchsorted(-(rest[order] // 8), -(k // 8), side="left")]
        if len(rows):
            crc[rows] = _advance(crc[rows], np.ascontiguousarray(data[(begin[rows] + k)[:, None] + np.arange(8)]))
    for j in range(7):
        rows = np.flatnonzero(rest % 8 > j)
        if len(rows):
            c = crc[rows]
            crc[rows] = (c >> 8) ^ TABLES[0][(c ^ data[begin[rows] + rest[rows] // 8 * 8 + j]) & 0xFF]
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> 15) | (crc << 17)) + np.uint32(MASK)).astype(np.uint32)


def frame(ids: list[int], tokens: list[np.ndarray], width: int = 2) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(framed records, their offsets, their lengths without the frame, masked checksums of the bytes)."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) * width + 8
    offsets = np.cumsum(sizes + 16) - sizes - 16
    out = np.zeros(int((sizes + 16).sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
        out[at[:, None] + np.arange(raw.shape[1])] = raw

    put(offsets, sizes)
    head = np.ascontiguousarray(sizes).view(np.uint8)
    put(offsets + 8, masked(crc32c(head, np.arange(len(sizes)) * 8, np.full(len(sizes), 8))))
    put(offsets + 12, np.array(ids, np.int64))
    for o, t in zip(offsets.tolist(), tokens):
        raw = t.astype("<u2" if width == 2 else "<u4").view(np.uint8)
        out[o + 20 : o + 20 + len(raw)] = raw
    sums = masked(crc32c(out, offsets + 12, sizes))
    put(offsets + 12 + sizes, sums)
    return out.tobytes(), offsets, sizes, sums


def ranks_path(name: str = RANKS) -> str:
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin) if found else "/opt/tokenizers", name)


_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes):
    """A byte-pair encoder from the bytes of a rank file; kept by the worker."""
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _ENCODERS[key]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    for spark_name, name in (("s3a://", "s3://"), ("abfss://", "abfs://")):
        path = path.replace(spark_name, name, 1) if path.startswith(spark_name) else path
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///", 1))
    return fs.LocalFileSystem(), path


INDEX = "doc_id long, file string, offset long, length long, tokens long, checksum long, width int"


def write_records(docs: DataFrame, path: str, ranks: str | None = None) -> DataFrame:
    """Writes records under ``path``/records and the index to ``path``/index; returns the index.

    One record and one index row (doc_id, file, offset, length, tokens, checksum, width: the bytes of an id) for each row with a text; an empty text is a
    record without ids. Rows with a null text or a null doc_id have no record. Equal rows have one record each; extra columns aren't read.
    An empty table gives an empty index. A text of any length is one record, encoded as a whole in its task.
    ``path`` lies on a file system that pyarrow reads by its address (file, hdfs, s3, gs, abfs; s3a and abfss addresses are read as those).
    """
    spark = docs.sparkSession
    with open(ranks or ranks_path(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    width = 2 if sent.value.count(b"\n") < 65_536 else 4
    folder = f"{path}/records"
    system, local = _open(folder)
    system.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        out, name, done = None, f"{uuid.uuid4().hex}.rec", 0
        try:
            for batch in batches:
                for piece in slices(batch, "text"):
                    if out is None:
                        system, local = _open(folder)
                        out = system.open_output_stream(f"{local}/{name}")
                    tokens = [encode.encode_to_numpy(t, disallowed_special=()) for t in piece.column("text").to_pylist()]
                    data, offsets, sizes, sums = frame(piece.column("doc_id").to_pylist(), tokens, width)
                    out.write(data)
                    n = len(tokens)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id"), pa.array([name] * n, pa.string()), pa.array(offsets + done), pa.array(sizes), pa.array((sizes - 8) // width), pa.array(sums.astype(np.int64)), pa.array(np.full(n, width, np.int32))],
                        ["doc_id", "file", "offset", "length", "tokens", "checksum", "width"],
                    )
                    done += len(data)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    named = {r[0] for r in index.select("file").distinct().collect()}  # one name for each task
    for entry in system.get_file_info(fs.FileSelector(local)):
        if entry.base_name not in named:
            system.delete_file(entry.path)
    return index


def read_records(index: DataFrame, path: str, check: bool = True) -> DataFrame:
    """(doc_id, ids) of the index rows, in their order within each partition; a wrong length or checksum raises."""
    folder = f"{path}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, local = _open(folder)
        files: dict = {}
        for batch in batches:
            who, ids = [], []
            for name, offset, length, width in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "width"))):
                if name not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[name] = system.open_input_file(f"{local}/{name}")
                raw = np.frombuffer(files[name].read_at(length + 16, offset), np.uint8)
                if check:
                    size = int(raw[:8].view(np.int64)[0])
                    good = size == length and masked(crc32c(raw, np.array([0, 12]), np.array([8, length]))).tolist() == [int(raw[8:12].copy().view(np.uint32)[0]), int(raw[12 + length :].copy().view(np.uint32)[0])]
                    if not good:
                        raise ValueError(f"broken record at {offset} of {name}")
                body = raw[12 : 12 + length]
                who.append(int(body[:8].copy().view(np.int64)[0]))
                ids.append(body[8:].copy().view("<u2" if width == 2 else "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        for f in files.values():
            f.close()

    return index.select("file", "offset", "length", "width").mapInArrow(run, "doc_id long, ids array<int>")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, **parameters) -> DataFrame:
    """All records in an order drawn from the seed: the small index is shuffled, the records are read where they lie."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    order = F.xxhash64(F.lit(seed), "file", "offset")
    return read_records(index.repartitionByRange(order).sortWithinPartitions(order), path, **parameters)


ORACLE_SQL = None  # files: tests/llm/test_records.py reads them back


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the records of all documents, which lie in the shared folder."""
    return write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "records").root)
