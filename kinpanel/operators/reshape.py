"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    """One row per id and column, rows with a missing value dropped. Columns absent from ``df`` are ignored."""
    present = [c for c in columns if c in df.columns]
    long = df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in present], name, value)
    return long.filter(F.col(value).isNotNull())


def to_wide(df: DataFrame, ids: Sequence[str], names: str, levels: Sequence[object], value: Column) -> DataFrame:
    """One row per id, one column per level holding an aggregate. Levels are always named: no extra pass finds them."""
    return df.groupBy(*ids).pivot(names, list(levels)).agg(value)


def to_wide_lists(df: DataFrame, ids: Sequence[str], names: str, levels: Sequence[object], value: str) -> DataFrame:
    """One row per id, one sorted list of distinct values per level; an absent cell is an empty list."""
    distinct = df.select(*ids, names, value).distinct()
    return to_wide(distinct, ids, names, levels, F.array_sort(F.collect_list(value)))


def transpose(df: DataFrame, row: str, columns: Sequence[str], row_levels: Sequence[object],
              name: str = "term") -> DataFrame:
    """Turn the columns of a result table into rows and its rows into columns."""
    long = df.unpivot([row], list(columns), name, "__value")
    return to_wide(long, [name], row, row_levels, F.first("__value", ignorenulls=True))


def stacked(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Union by column name, each part marked with its key."""
    out = None
    for key, part in parts.items():
        marked = part.withColumn(label, F.lit(key))
        out = marked if out is None else out.unionByName(marked)
    return out
