"""Metadata predicates: composable filters, dictionaries of operators, and their two-valued logic.

A negated test is the exact complement of the test: a missing value fails every comparison but
``ne`` and ``nin``. A row without metadata fails every predicate, negated or not.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def is_numeric(schema: StructType | None, name: str) -> bool:
    return schema is not None and name in schema.names and isinstance(schema[name].dataType, NumericType)


def positive(field: Column, op: str, value: Any, numeric: bool = False) -> Column:
    """The test as a filter needs it: null where it fails for want of a value. Bare comparisons, which reach the scan.

    ``numeric``: the field is known to be a number and is compared as it is; otherwise it is tried as one.
    """
    if op in ("gt", "gte", "lt", "lte"):
        number = field if numeric else field.try_cast("double")
        return {"gt": number > value, "gte": number >= value, "lt": number < value, "lte": number <= value}[op]
    if op == "eq":
        return field == F.lit(value)
    if op == "ne":  # against a missing value every value is different, but a missing one
        return field.isNotNull() if value is None else field.isNull() | (field != F.lit(value))
    if op == "in":
        return field.isin(list(value))
    if op == "nin":
        return field.isNull() | ~field.isin(list(value))
    if op == "contains":
        return F.contains(field.cast("string"), F.lit(str(value)))
    if op == "regex":
        return field.cast("string").rlike(value)
    if op == "exists":
        return field.isNotNull() if value else field.isNull()
    if op == "list_contains":
        return F.array_contains(field, value)
    if op == "contains_key":
        return F.map_contains_key(field, value)
    raise ValueError(f"unknown operator: {op}")


#: Tests that are each other's complement, missing values included, in a form that scans evaluate.
OPPOSITE = {"eq": "ne", "ne": "eq", "in": "nin", "nin": "in"}


def compare(field: Column, op: str, value: Any, negate: bool = False, numeric: bool = False) -> Column:
    """One comparison or, with ``negate``, its exact complement; a value that cannot be compared is no match."""
    if not negate:
        return positive(field, op, value, numeric)
    if op in OPPOSITE:
        return positive(field, OPPOSITE[op], value, numeric)
    if op == "exists":
        return positive(field, op, not value)
    return ~F.coalesce(positive(field, op, value, numeric), F.lit(False))


@dataclass(frozen=True)
class Filter:
    """A predicate that combines with & | ~; ``column()`` compiles it, given how a field is read. Negation is pushed down to the tests, so that
    of a conjunction whatever the scan can evaluate reaches it."""

    build: Any  # (read, schema, negate) -> Column

    @staticmethod
    def of(field: str, op: str, value: Any = None) -> Filter:
        return Filter(lambda read, schema, negate: compare(read(field), op, value, negate, is_numeric(schema, field)))

    @staticmethod
    def eq(field: str, value: Any) -> Filter:
        return Filter.of(field, "eq", value)

    @staticmethod
    def ne(field: str, value: Any) -> Filter:
        return Filter.of(field, "ne", value)

    @staticmethod
    def between(field: str, low: Any, high: Any) -> Filter:
        return Filter.of(field, "gte", low) & Filter.of(field, "lte", high)

    @staticmethod
    def from_dict(spec: dict) -> Filter | None:
        """{field: value or {$gt $gte $lt $lte $ne $in $nin $contains $contains_key $exists $regex: value}}, all of which must hold; other operators are ignored."""
        names = {"$gt", "$gte", "$lt", "$lte", "$ne", "$in", "$nin", "$contains", "$contains_key", "$exists", "$regex"}
        parts = []
        for field, want in spec.items():
            if isinstance(want, dict):
                parts += [Filter.of(field, op[1:], v) for op, v in want.items() if op in names]
            else:
                parts.append(Filter.eq(field, want))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def __and__(self, other: Filter) -> Filter:
        def build(read, schema, negate):
            a, b = self.build(read, schema, negate), other.build(read, schema, negate)
            return a | b if negate else a & b

        return Filter(build)

    def __or__(self, other: Filter) -> Filter:
        return ~(~self & ~other)

    def __invert__(self) -> Filter:
        return Filter(lambda read, schema, negate: self.build(read, schema, not negate))

    def column(self, read: Any = F.col, metadata: Column | None = None, schema: StructType | None = None) -> Column:
        """The predicate for ``filter``: true where it holds, false or null elsewhere. ``metadata``: the column that must not be null for
        any predicate to hold. With the table's ``schema`` numbers are compared without a cast."""
        made = self.build(read, schema, False)
        return made if metadata is None else metadata.isNotNull() & made


def json_field(json: str):
    """Reads fields of a JSON string column, as strings."""
    return lambda name: F.get_json_object(F.col(json), f"$.{name}")
