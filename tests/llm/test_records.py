from collections import Counter

import numpy as np
import pytest
import tiktoken  # noqa: F401  the encoder under test is built from its ranks

from vecloom.llm import records


def slow_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert slow_crc(b"123456789") == 0xE3069283
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 12_000, dtype=np.uint8)
    sizes = np.array([0, 1, 7, 8, 9, 511, 512, 513, 519, 520, 1023, 1024, 1025, 3001, 9999])
    starts = rng.integers(0, 2000, len(sizes))
    assert records.crc32c(data, starts, sizes).tolist() == [slow_crc(data[s : s + n].tobytes()) for s, n in zip(starts, sizes)]


def expected(rows):
    with open(records.ranks_path(), "rb") as f:
        encode = records.encoder(f.read())
    return Counter((r[0], tuple(encode.encode_ordinary(r[1]))) for r in rows if r[0] is not None and r[1] is not None)


def test_round_trip(spark, docs, rows, tmp_path):
    index = records.write_records(docs, str(tmp_path))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in records.read_shuffled(spark, str(tmp_path), seed=1).collect())
    assert got == expected(rows)
    assert sorted(p.name for p in (tmp_path / "records").iterdir()) == sorted(r[0] for r in index.select("file").distinct().collect())
    # The frames are read without the index too.
    found = Counter()
    for p in (tmp_path / "records").iterdir():
        raw, at = p.read_bytes(), 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
            assert int.from_bytes(raw[at + 8 : at + 12], "little") == mask(slow_crc(raw[at : at + 8]))
            if n < 2000:
                assert int.from_bytes(raw[at + 12 + n : at + 16 + n], "little") == mask(slow_crc(raw[at + 12 : at + 12 + n]))
            body = raw[at + 12 : at + 12 + n]
            found[(int.from_bytes(body[:8], "little", signed=True), tuple(np.frombuffer(body[8:], "<u2").tolist()))] += 1
            at += n + 16
    assert found == expected(rows)


def test_order_follows_the_seed(spark, docs, tmp_path):
    records.write_records(docs, str(tmp_path))
    orders = [[r["doc_id"] for r in records.read_shuffled(spark, str(tmp_path), seed=s).collect()] for s in (1, 2, 1)]
    assert orders[0] == orders[2] != orders[1]


def test_damage_is_found(spark, docs, tmp_path):
    index = records.write_records(docs, str(tmp_path))
    one = index.orderBy("file", "offset").first()
    path = tmp_path / "records" / one["file"]
    raw = bytearray(path.read_bytes())
    raw[one["offset"] + 14] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="broken record"):
        records.read_records(index, str(tmp_path)).collect()


def test_ids_of_four_bytes(spark, tmp_path):
    """A vocabulary of more than 65,536 ids is written with four bytes an id, and the index says so to the reader."""
    import base64

    ranks = [bytes([b]) for b in range(256)]
    seen = set(ranks)
    for a in range(97, 123):  # pairs, then pairs with a third and a fourth letter, so that every merge has both parts
        for b in range(97, 123):
            ranks.append(bytes([a, b]))
    for p in list(ranks[256:]):
        ranks += [p + bytes([c]) for c in range(97, 123)]
    for p in list(ranks[256 + 676 :]):
        ranks += [p + bytes([c]) for c in range(97, 101)]
    assert len(ranks) > 65_536 and len(set(ranks)) == len(ranks) and seen <= set(ranks)
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(r) + b" " + str(i).encode() + b"\n" for i, r in enumerate(ranks)))
    df = spark.createDataFrame([(1, "zzza zzzd"), (2, ""), (3, "abcd")], "doc_id long, text string")
    index = records.write_records(df, str(tmp_path / "out"), str(path))
    encode = records.encoder(path.read_bytes())
    got = {r["doc_id"]: r["ids"] for r in records.read_records(index, str(tmp_path / "out")).collect()}
    assert got == {i: encode.encode_ordinary(t) for i, t in ((1, "zzza zzzd"), (2, ""), (3, "abcd"))} and max(got[1]) > 65_535
    assert {r["width"] for r in index.collect()} == {4}


def test_empty(spark, empty, tmp_path):
    assert records.write_records(empty, str(tmp_path)).count() == 0
    assert records.read_shuffled(spark, str(tmp_path)).count() == 0
