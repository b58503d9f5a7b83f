"""Running totals, exact quantiles and scans in order without sorting a whole group in one task.

Rows are dealt out by ranges of (group, value), so a stretch holds neighbours in order, however many rows a group has. What
a stretch adds up to is one row for each of its groups; carrying that from stretch to stretch gives every row what came
before, and only the rows inside a stretch are put in order. The number of stretches is that of Spark's shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.session import checkpointed_with

PART = "__part"


def ranged(df: DataFrame, order: list[str], parts: int | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` with ``__part``, its stretch in the order, as a written table, and what was observed on the way.

    ``last`` is the number of the last stretch. The cuts come from a sample of the rows, the rows do not.
    """
    dealt = df.repartitionByRange(*([parts] if parts else []), *order).withColumn(PART, F.spark_partition_id())
    return checkpointed_with(dealt, last=F.max(PART), **metrics)


def running_totals(df: DataFrame, groups: list[str], value: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """Add ``before_<c>`` (total of c over smaller values) and ``total_<c>`` (of the group) for each c in ``sums``.

    ``df`` must hold one row per (groups, value): aggregate first.
    """
    cut, seen = ranged(df, [*groups, value], parts)
    if not seen["last"]:
        # all rows are one stretch
        before, everyone = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
        return cut.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}).withColumns(
            {f"total_{c}": F.sum(c).over(everyone) for c in sums}).drop(PART)
    per_part = cut.groupBy(*groups, PART).agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    # one row per stretch of a group
    everything = Window.partitionBy(*groups)
    earlier = everything.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *groups, PART,
        *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums],
        *[F.sum(f"__s_{c}").over(everything).alias(f"total_{c}") for c in sums])
    keys = [*groups, PART]
    offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                             *[c for c in offsets.columns if c not in keys])
    cond = [cut[k].eqNullSafe(offsets[f"__k{i}"]) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, cond, "inner")
    for c in sums:
        joined = joined.withColumn(f"before_{c}", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return joined.drop(PART, *[f"__k{i}" for i in range(len(keys))], *[f"__o_{c}" for c in sums])


def latest_before(df: DataFrame, keys: list[str], time: str, seen: Column, out: str, parts: int | None = None,
                  **metrics: Column) -> tuple[DataFrame, dict]:
    """Add ``out``, the last non-null ``seen`` of the key at or before the row's time, and ``__part``.

    ``df`` must hold one row per (keys, time). The last value of a stretch is carried to the stretches that its key goes on
    in; a stretch has at most one key that began before it.
    """
    cut, found = ranged(df, [*keys, time], parts, **metrics)
    if not found["last"]:
        return cut.withColumn(out, F.last(seen, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time))), found
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, PART).agg(F.max(seen).alias("__last")).withColumn("__carry", F.max("__last").over(earlier))
    carried = carried.filter(F.col("__carry").isNotNull()).select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col(PART).alias("__c_part"), "__carry")
    cond = [cut[k] == carried[f"__c_{k}"] for k in keys] + [cut[PART] == carried["__c_part"]]
    inside = F.last(seen, ignorenulls=True).over(Window.partitionBy(*keys, PART).orderBy(time))
    return cut.join(carried, cond, "left").withColumn(out, F.coalesce(inside, F.col("__carry"))).drop(
        "__carry", "__c_part", *[f"__c_{k}" for k in keys]), found


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
                    parts: int | None = None) -> DataFrame:
    """Linearly interpolated (type 7) quantiles per group, one column per name in ``probs``; NULL values are skipped.

    ``percentile`` would hold every distinct value of a group in one task's memory; this finds the order statistics
    from running counts instead.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(hist, groups, value, ["n"], parts)
    first, after = F.col("before_n"), F.col("before_n") + F.col("n")
    picks = []
    for name, p in probs.items():
        place = (F.col("total_n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        picks += [
            F.max(F.when((first <= low) & (low < after), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when((first <= high) & (high < after), F.col(value))).alias(f"__hi_{name}"),
            F.max(place - low).alias(f"__f_{name}"),
        ]
    found = ranked.groupBy(*groups).agg(*picks)
    return found.select(*groups, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n) for n in probs])

