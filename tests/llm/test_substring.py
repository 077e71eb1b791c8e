import random
from collections import Counter

from vecloom.llm import substring


def brute(rows, least=substring.SENTENCES, chars=substring.CHARS):
    """Text and number of removed sentences of every row, by comparing strings."""
    seen, covered = {}, {}
    keyed = {(r[0], r[1]) for r in rows if r[1]}
    import xxhash  # only for the order of texts that share a doc_id

    for doc, text in sorted(keyed, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42))):
        pieces = substring.sentences(text)
        low = [p.rstrip(" \t\r\n").lower() for p in pieces]
        gone = covered.setdefault((doc, text), set())
        for i in range(len(pieces)):
            j = i
            while j < len(pieces) and (j - i + 1 < least or sum(map(len, low[i : j + 1])) < chars):
                j += 1
            if j == len(pieces):
                continue
            run = tuple(low[i : j + 1])
            if run in seen:
                gone.update(range(i, j + 1))
            else:
                seen[run] = (doc, text, i)
    out = []
    for doc, text, *_ in rows:
        if not text:
            out.append((doc, text, 0))
        else:
            gone = covered[(doc, text)]
            out.append((doc, "".join(p for i, p in enumerate(substring.sentences(text)) if i not in gone), len(gone)))
    return out


def test_sentences_add_up(rows):
    for r in rows:
        if r[1]:
            assert "".join(substring.sentences(r[1])) == r[1]


def test_against_brute_force(docs, rows):
    got = substring.drop_repeated_spans(docs, gone="removed")
    assert got.columns == [*docs.columns, "removed"]
    assert Counter((r["doc_id"], r["text"], r["removed"]) for r in got.collect()) == Counter(brute(rows))


def test_repeat_within_a_text(spark):
    a, b = "One two three four five six seven.", "Eight nine ten eleven twelve thirteen."
    df = spark.createDataFrame([(1, f"{a} {b} Between them. {a} {b}")], "doc_id long, text string")
    assert substring.drop_repeated_spans(df).first()["text"] == f"{a} {b} Between them. "


def test_empty(empty):
    assert substring.drop_repeated_spans(empty).count() == 0


def every_run(rows, least=substring.SENTENCES, chars=substring.CHARS):
    """Text of every row by the rule that takes every run of any length; doc_ids differ."""
    seen, out = set(), []
    for _, text in sorted(rows):
        pieces = substring.sentences(text)
        low = [p.rstrip(" \t\r\n").lower() for p in pieces]
        gone = set()
        for i in range(len(pieces)):
            for j in range(i + least, len(pieces) + 1):
                if sum(map(len, low[i:j])) >= chars:
                    if tuple(low[i:j]) in seen:
                        gone.update(range(i, j))
                    seen.add(tuple(low[i:j]))
        out.append("".join(p for i, p in enumerate(pieces) if i not in gone))
    return out


def test_every_run(spark):
    """Passages that end in sentences too short for a span of their own, and random short sentences."""
    a, b, c = "A sentence that has about fifty characters in it. ", "Twenty characters. ", "And ten. "
    rng = random.Random(5)
    rows = [(0, f"{a}{b}{c}First text goes on."), (1, f"Another text. {a}{b}{c}It differs here.")]
    rows += [(i, "".join(rng.choice("abc") * rng.choice([3, 9, 30]) + ". " for _ in range(rng.randint(1, 25)))) for i in range(2, 60)]
    got = substring.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every=True)
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == every_run(rows)
    assert every_run(rows)[1] == "Another text. It differs here."


def test_passage_in_one_sentence(spark):
    """Runs of 50 words in long sentences, copies of one-sentence texts, and the marks of other scripts."""
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words[:70])
    rows = [
        (0, f"Start {long} here the first ends."),
        (1, f"It begins otherwise {long} and goes on."),
        (2, " ".join(words[100:160])),
        (3, " ".join(words[100:160])),
        (4, "Before. " + " ".join(words[200:249]) + " end."),
        (5, "Other. " + " ".join(words[200:249]) + " stop."),
        (6, "la " * 120 + "end."),
        (7, "这是第一个相当长的句子它有二十多个字来凑足长度。" + "这是第二个同样相当长的句子它也有二十多个字。" + "甲。"),
        (8, "这是第一个相当长的句子它有二十多个字来凑足长度。" + "这是第二个同样相当长的句子它也有二十多个字。" + "乙。"),
    ]
    got = [r["text"] for r in substring.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), every=True).orderBy("doc_id").collect()]
    want = [r[1] for r in rows]
    want[1], want[3], want[6], want[8] = "It begins otherwise and goes on.", "", "la end.", "乙。"
    assert got == want


def test_word_runs_against_brute_force(spark):
    """One-sentence texts made of few passages, so that runs repeat between and within texts."""
    rng = random.Random(11)
    passages = [[f"p{k}x{i}" for i in range(rng.randint(30, 80))] for k in range(12)]
    texts = [[w for _ in range(rng.randint(1, 4)) for w in rng.choice(passages)] for _ in range(40)]
    seen, want = set(), []
    for t in texts:
        gone = set()
        for i in range(len(t) - substring.WORDS + 1):
            run = tuple(t[i : i + substring.WORDS])
            if run in seen:
                gone.update(range(i, i + substring.WORDS))
            seen.add(run)
        want.append([w for i, w in enumerate(t) if i not in gone])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert [r["text"].split() for r in substring.drop_repeated_spans(df, every=True).orderBy("doc_id").collect()] == want


def test_no_run_of_words_stays_twice(spark):
    """Passages cut anywhere out of texts with sentences of any length."""
    rng = random.Random(17)
    base = [f"q{i}" + rng.choice(["", "", "", "", "", ".", "?"]) * (i % rng.randint(1, 9) == 0) for i in range(1500)]
    texts = [base[a : a + rng.randint(40, 200)] + [f"own{i}x{k}" for k in range(rng.randint(0, 40))] for i in range(60) for a in [rng.randint(0, 1400)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [r["text"].split() for r in substring.drop_repeated_spans(df, every=True).orderBy("doc_id").collect()]
    n = substring.WORDS
    runs = Counter((tuple(t[i : i + n]), k) for k, t in enumerate(got) for i in range(len(t) - n + 1))
    assert max(Counter(run for run, _ in runs).values()) == 1
    assert {w for t in texts for w in t} == {w for t in got for w in t}


def test_hot_passage_sends_one_row_a_batch(spark):
    """Of a passage in every document, one row of each batch takes part in the comparison; the result is the same."""
    passage = "A passage of one sentence here. And of another one that follows."
    rows = [(i, f"Text number {i} begins. {passage} It ends as {i * i}.") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    (code, more, *_), (settled, _) = substring.unpacked(substring.packed_spans(df, 3).toArrow())
    assert max(Counter(zip(code.tolist(), more.tolist())).values()) <= 4 and len(settled) >= 396
    got = substring.drop_repeated_spans(df, gone="removed").collect()
    assert Counter((r["doc_id"], r["text"], r["removed"]) for r in got) == Counter(brute(rows))


def test_places_of_very_long_texts():
    """A tag and a place share 64 bits: 28 for the tag with its sign, 36 for the place, which no text exceeds."""
    assert substring.TAG_BITS + 1 + substring.PLACE_BITS == 64 and substring.WORD_PLACES > 2 * 2**31


def test_buckets_and_batches(spark, docs, rows, monkeypatch):
    """Spans split over many buckets, batches of a few documents: the same result."""
    want = Counter((r["doc_id"], r["text"]) for r in substring.drop_repeated_spans(docs, every=True).collect())
    monkeypatch.setattr(substring, "BUCKET_BYTES", 5000)
    assert Counter((r["doc_id"], r["text"]) for r in substring.drop_repeated_spans(docs, every=True).collect()) == want
