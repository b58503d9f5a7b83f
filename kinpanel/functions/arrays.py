"""Predicates on list columns with a missing list read as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_value(items: Column, value: object) -> Column:
    """True if the list holds ``value``; false for a missing list."""
    return F.coalesce(F.array_contains(items, F.lit(value)), F.lit(False))


def has_any(items: Column, values: Sequence[object]) -> Column:
    """True if the list holds any of ``values``; false for a missing list."""
    return F.coalesce(F.arrays_overlap(F.array_compact(items), F.array(*[F.lit(v) for v in values])), F.lit(False))


def count_value(items: Column, value: object) -> Column:
    """How often ``value`` stands in the list; 0 for a missing list."""
    return F.coalesce(F.size(F.filter(items, lambda x: x == F.lit(value))), F.lit(0))


def length(items: Column) -> Column:
    """List length; 0 for a missing list."""
    return F.when(items.isNull(), F.lit(0)).otherwise(F.size(items))


def only_value(items: Column) -> Column:
    """The single element of a one-element list, NULL for any other list."""
    return F.when(F.size(items) == 1, F.element_at(items, 1))


def joined(items: Column, sep: str = ",") -> Column:
    """List as text, for output formats without lists."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), sep)
