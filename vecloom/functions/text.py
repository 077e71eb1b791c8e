"""Text expressions: tokens, redaction, chunks, counts, routes, URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

STOP = "a an and are as at be by for from has he in is it its of on that the to was were will with this but".split()
#: Applied in this order; a pattern may consume what a later one would have matched.
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("phone", r"\+?1?[ \t\r\n]*\(?[0-9]{3}\)?[-. \t\r\n]?[0-9]{3}[-. \t\r\n]?[0-9]{4}", "[PHONE]"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]"),
    ("card", r"\b(?:[0-9]{4}[- \t\r\n]?){3}[0-9]{4}\b", "[CC]"),
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP]"),
    ("zip", r"\b[0-9]{5}(?:-[0-9]{4})?\b", "[ZIP]"),
]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "ref_src"]


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores that stand alone as words in any script."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.transform(F.filter(runs, lambda w: w.rlike("^[a-zA-Z0-9_]+$")), F.lower)


def substring_count(text: Column, part: Column) -> Column:
    """Occurrences, not overlapping, upper and lower case alike."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, part, F.lit("")))) / F.length(part)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def sentence_chunks(text: Column, most: int = 5, overlap: int = 1) -> Column:
    """Windows of ``most`` sentences, each beginning ``most - overlap`` after the last. The text is split once: its sentences are bound as the only element of an array."""

    def windows(found: Column) -> Column:
        starts = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found), F.lit(most - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, F.lit(most)), " "))

    return F.get(F.transform(F.array(sentences(text)), windows), F.lit(0))


def redact(text: Column) -> Column:
    for _, pattern, label in PII:
        text = F.regexp_replace(text, pattern, F.lit(label))
    return text


def redact_fields(record: Column, kind: DataType, labels: dict[str, str]) -> Column:
    """A record in which fields of the given names, at any depth, hold their label; its schema stays, but that they are strings."""
    if isinstance(kind, StructType):
        return F.struct(*[(F.when(record[f.name].isNotNull(), F.lit(labels[f.name])) if f.name in labels else redact_fields(record[f.name], f.dataType, labels)).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.transform(record, lambda x: redact_fields(x, kind.elementType, labels))
    if isinstance(kind, MapType):
        masked = lambda k, v: F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[k], v) if isinstance(kind.valueType, StringType) else redact_fields(v, kind.valueType, labels)
        return F.transform_values(record, masked)
    return record


def in_context(summary: Column, chunk: Column) -> Column:
    """A chunk behind a summary of its document; without one the chunk itself."""
    return F.when(F.coalesce(summary, F.lit("")) == "", chunk).otherwise(F.concat(F.lit("Summary: "), summary, F.lit("\n\n"), chunk))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, the others sorted; an empty path is /."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    tail = F.array_join(kept, "&")
    return F.concat(head, F.when(path == "", F.lit("/")).otherwise(path), F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("?"), tail)))


def page_id(url: Column) -> Column:
    return F.concat(F.lit("web_"), F.substring(F.sha1(url), 1, 24))


def intent(query: Column) -> Column:
    """QA if it asks, EXPLORATORY if it has more than seven words, else EXACT."""
    low = F.lower(query)
    asks = F.lit(False)
    for w in ("what", "how", "why", "who", "when", "?"):
        asks = asks | F.contains(low, F.lit(w))
    return F.when(asks, "QA").when(F.size(words(query)) > 7, "EXPLORATORY").otherwise("EXACT")


def highlight(text: Column, terms: list[str]) -> Column:
    """Whole-word matches of the terms, in any case, between two pairs of stars."""
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b", F.lit("**$1**"))
