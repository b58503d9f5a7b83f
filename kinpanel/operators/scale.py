"""Joins and group statistics that stay balanced when one key holds a large part of all rows.

A window over a raw entity key puts the whole entity into one task. The operators here aggregate first (partial
aggregation runs before the shuffle, so a hot key sends one row per task) and join the small result back. The rows of each
key are counted in the same pass, and the largest count is observed while the result is written: if a key is hot, its rows
are spread over several join partitions, else the join is a plain one. Other joins count their keys in a pass of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.session import checkpointed, checkpointed_with

# A key with more rows than this is cut into parts of about this size: rows that one task joins with ease.
HOT_ROWS = 200_000
# Largest row count of a table that may be broadcast after counting it.
BROADCAST_ROWS = 100_000

_SALT = "__salt"


def _salts(counts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` in ``__rows``, and the number of parts to cut each into."""
    return counts.filter(F.col("__rows") > rows).select(*keys, F.ceil(F.col("__rows") / F.lit(rows)).cast("int").alias("__salts"))


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame | None:
    """Hot keys with ``__salts``, the number of parts of about ``rows`` rows to cut each into; None if there are none.

    One pass over the key columns. The list is written, not fetched: there is at most one entry per ``rows`` rows, so it
    grows with the data, and Spark broadcasts it only while it is small.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot, seen = checkpointed_with(_salts(counts, keys, rows or HOT_ROWS), found=F.count(F.lit(1)))
    return hot if seen["found"] else None


def _match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool) -> Column:
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def _renamed(df: DataFrame, keys: list[str], mark: str) -> tuple[DataFrame, list[str]]:
    """``df`` with fresh key columns, so that joins of tables with common ancestry stay unambiguous."""
    names = [f"__{mark}_{k}" for k in keys]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], *rest), names


def _with_salts(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Add ``__salts``. NULL finds its own entry, whatever the join does with it: an outer join moves such rows, too."""
    small, names = _renamed(hot, keys, "h")
    return df.join(small, _match(df, small, list(zip(keys, names)), True), "left").drop(*names)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", null_safe: bool = False,
                rows: int | None = None, check: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join in which hot keys of ``left`` are cut into parts and the matching rows of ``right`` repeated.

    ``how`` is inner, left, left_semi or left_anti. A key of n rows is cut into ceil(n / rows) parts and ``right`` grows by
    as many copies of that key's rows. If there is a hot key, ``left`` is written with a row number first: parts come from
    that number, so equal rows are spread, too, and a recomputed task reads the same number again.
    ``check=False`` leaves the counting out where the left keys are known to repeat only a few times; ``hot`` passes on the
    result of ``hot_keys`` for the same keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how!r}")
    found = hot if hot is not None else hot_keys(left, on, rows) if check else None
    if found is not None:
        left = checkpointed(left.withColumn("__row", F.monotonically_increasing_id()))
        part = F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64("__row"), F.col("__salts").cast("bigint")).cast("int"))
        left = _with_salts(left, on, found).withColumn(_SALT, part).drop("__salts", "__row")
        right = (
            _with_salts(right, on, found)
            .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
            .drop("__salts")
        )
    keys = [*on, _SALT] if found is not None else list(on)
    right, names = _renamed(right, keys, "r")
    cond = _match(left, right, list(zip(on, names)), null_safe)
    if found is not None:
        cond = cond & (left[_SALT] == right[names[-1]])
    return left.join(right, cond, how).drop(_SALT, *names)


def written_stats(counted: DataFrame, keys: list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``counted`` as a written table, and the hot keys of the rows behind it, for ``salted_join``.

    ``counted`` has one row per key with its statistics and ``__rows``, how many rows the key has.
    """
    rows = rows or HOT_ROWS
    stats, seen = checkpointed_with(counted, most=F.max("__rows"))
    return stats.drop("__rows"), _salts(stats, keys, rows) if (seen["most"] or 0) > rows else None


def attach_counted(df: DataFrame, keys: list[str], counted: DataFrame, rows: int | None = None) -> DataFrame:
    """Add the statistics of the row's group, from one row per group with ``__rows``, to every row. NULL is a group."""
    stats, hot = written_stats(counted, keys, rows)
    return salted_join(df, stats, keys, "inner", null_safe=True, check=False, hot=hot)


def attach_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Add aggregates of the row's group to every row, like ``agg().over(partitionBy(keys))`` without the window.

    NULL is a group of its own. ``df`` is read twice: for the aggregates, which count the rows as well, and for the join.
    """
    return attach_counted(df, keys, df.groupBy(*keys).agg(
        *[expr.alias(name) for name, expr in aggs.items()], F.count(F.lit(1)).alias("__rows")))


def keep_at_extreme(df: DataFrame, keys: list[str], value: str, pick: str = "min") -> DataFrame:
    """Rows whose ``value`` equals the group's minimum or maximum; every tie is kept."""
    best = attach_stats(df, keys, __best={"min": F.min, "max": F.max}[pick](value))
    return best.filter(F.col(value) == F.col("__best")).drop("__best")


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                 rows: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Join with a right side expected to be small: materialise and count it, broadcast it only if it is, else salt."""
    right, seen = checkpointed_with(right, n=F.count(F.lit(1)))
    if seen["n"] <= rows:
        spread, names = _renamed(right, on, "r")
        return left.join(F.broadcast(spread), _match(left, spread, list(zip(on, names)), null_safe), how).drop(*names)
    return salted_join(left, right, on, how, null_safe)
