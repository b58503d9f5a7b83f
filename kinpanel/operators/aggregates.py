"""Group aggregates, shares and reconciliation of contradictory answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.functions.expressions import Rule, choose
from kinpanel.operators.ordering import exact_quantiles
from kinpanel.operators.scale import attach_counted, attach_stats, join_counted, salted_join, written_stats
from kinpanel.session import checkpointed


def entity_min(df: DataFrame, entity: Sequence[str], value: str, out: str, propagate_null: bool = False,
               one_per_wave: bool = False) -> DataFrame:
    """Smallest reported value of the entity on all its rows; optionally NULL as soon as one report is missing.

    ``one_per_wave`` says that an entity has at most one row per survey wave. Its rows are then so few that a window
    needs one shuffle less than aggregating and joining back.
    """
    found = F.min(value)
    gaps = F.count(F.when(F.col(value).isNull(), 1))
    if one_per_wave:
        whole = Window.partitionBy(*entity)
        found = found.over(whole)
        return df.withColumn(out, F.when(gaps.over(whole) == 0, found) if propagate_null else found)
    return entity_minima(df, entity, {out: (value, propagate_null)})


def entity_minima(df: DataFrame, entity: Sequence[str], answers: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """``entity_min`` of several answers at once: {new column: (answer, propagate_null)}."""
    aggs = {}
    for out, (value, propagate_null) in answers.items():
        gaps = F.count(F.when(F.col(value).isNull(), 1))
        aggs[out] = F.when(gaps == 0, F.min(value)) if propagate_null else F.min(value)
    return attach_stats(df, list(entity), **aggs)


def ever_flag(df: DataFrame, entity: Sequence[str], flag: str, out: str) -> DataFrame:
    """1 on all rows of an entity with a true flag anywhere; missing counts as 0."""
    return attach_stats(df, list(entity), **{out: F.max(F.coalesce(F.col(flag), F.lit(0)))})


def carry_forward_flag(df: DataFrame, entity: Sequence[str], time: str, flag: str, out: str) -> DataFrame:
    """1 from the entity's first true flag onward, 0 before: a comparison with the first true time, so no sort."""
    first = F.min(F.when(F.col(flag) == 1, F.col(time)))
    marked = attach_stats(df, list(entity), __first=first)
    return marked.withColumn(out, F.coalesce((F.col(time) >= F.col("__first")).cast("int"), F.lit(0))).drop("__first")


def quantile_band(df: DataFrame, groups: Sequence[str], value: str, out: str, labels: Sequence[str]) -> DataFrame:
    """Equal-share band of ``value`` within its group, upper edges inclusive; a missing value has no band."""
    cuts = {f"__q{i}": i / len(labels) for i in range(1, len(labels))}
    bounds = exact_quantiles(df, list(groups), value, cuts)
    rules: list[Rule] = [(F.col(value) <= F.col(q), label) for q, label in zip(cuts, labels)]
    rules.append((F.col(value).isNotNull(), labels[-1]))
    return join_counted(df, bounds, list(groups), "left").withColumn(out, choose(rules)).drop(*cuts)


def aligned_lists(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Parallel lists of distinct value tuples per group, row-aligned with each other and sorted by the first."""
    names = list(columns)
    rows = df.select(*keys, *[F.col(c).alias(n) for n, c in columns.items()]).distinct()
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__rows"))
    return grouped.select(*keys, *[F.col("__rows")[n].alias(n) for n in names])


def _by_distinct(df: DataFrame, keys: Sequence[str], value: str, **more: str) -> DataFrame:
    """Rows, distinct values and greatest values of further columns per group, counted by (group, value) first.

    A hot group is so split over its own values before it meets in one row.
    """
    per_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__rows"), *[F.max(c).alias(n) for n, c in more.items()])
    return per_value.groupBy(*keys).agg(F.sum("__rows").alias("__rows"), F.count(value).alias("__kinds"),
                                        *[F.max(n).alias(n) for n in more])


def unambiguous(df: DataFrame, keys: Sequence[str], value: str, kinds: str | None = None) -> DataFrame:
    """Rows of groups with exactly one distinct value; ``kinds`` names the distinct count, if it is to stay."""
    marked = attach_counted(df, list(keys), _by_distinct(df, keys, value)).filter(F.col("__kinds") == 1)
    return marked.withColumnRenamed("__kinds", kinds) if kinds else marked.drop("__kinds")


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Number of distinct values of the row's group on every row."""
    return attach_counted(df, list(keys), _by_distinct(df, keys, value)).withColumnRenamed("__kinds", out)


def class_shares(df: DataFrame, outer: Sequence[str], inner: Sequence[str], entity: str | None = None,
                 n: str = "n", share: str = "share", weight: str | None = None) -> DataFrame:
    """Rows (or distinct entities) per outer x inner class and their share of the outer class.

    The large input is reduced to one row per class in one pass; the outer totals come from that small table. With
    ``weight`` a row stands for as many rows, as after counting below a join.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1)) if entity is None else F.countDistinct(entity)
    counts = df.groupBy(*outer, *inner).agg(size.alias(n))
    if not outer:
        total = counts.agg(F.sum(n).alias("__t")).scalar()
        return counts.withColumn(share, F.col(n) / total)
    totals = counts.groupBy(*[F.col(c).alias(f"__t_{c}") for c in outer]).agg(F.sum(n).alias("__t"))
    cond = [counts[c].eqNullSafe(totals[f"__t_{c}"]) for c in outer]
    return (counts.join(totals, cond).withColumn(share, F.col(n) / F.col("__t"))
            .drop("__t", *[f"__t_{c}" for c in outer]))


def group_rate(df: DataFrame, groups: Sequence[str], hit: Column, out: str = "rate") -> DataFrame:
    """Share of rows that meet a condition; an unknown condition counts as not met."""
    return df.groupBy(*groups).agg((F.sum(F.when(hit, 1).otherwise(0)) / F.count(F.lit(1))).alias(out))


def count_of_counts(df: DataFrame, keys: Sequence[str], size: str = "size", groups: str = "groups") -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)).groupBy(size).agg(F.count(F.lit(1)).alias(groups))


def groups_of_size(df: DataFrame, keys: Sequence[str], test: Column, size: str = "n") -> DataFrame:
    """Keys of the groups whose row count, named ``size``, passes ``test``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)).filter(test)


def fewer_distinct(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Keys of the groups with fewer distinct ``a`` than distinct ``b``.

    Both columns are counted in two steps over (keys, column), so a hot group is split over its own values.
    """
    count_a = df.groupBy(*keys).agg(F.countDistinct(a).alias("__a"))
    count_b = df.groupBy(*keys).agg(F.countDistinct(b).alias("__b"))
    return count_a.join(count_b, list(keys)).filter(F.col("__a") < F.col("__b")).select(*keys)


def reconciled_size(df: DataFrame, keys: Sequence[str], member: str, order: str, listed: Column,
                    out: str) -> DataFrame:
    """Group size as the greatest of: members listed on the row, distinct members seen, largest order number."""
    joined = attach_counted(df, list(keys), _by_distinct(df, keys, member, __last=order))
    return joined.withColumn(out, F.greatest(listed, F.col("__kinds"), F.col("__last")).cast("int")).drop("__kinds", "__last")


def has_other_class(df: DataFrame, keys: Sequence[str], value: str, out: str, small_groups: bool = False) -> DataFrame:
    """Does the row's group hold a class other than its own? It does exactly if the group's classes are not all equal.

    ``small_groups`` says that a group is never larger than a household, so that a window may hold it.
    """
    low, high = F.min(value), F.max(value)
    if small_groups:
        whole = Window.partitionBy(*keys)
        low, high = low.over(whole), high.over(whole)
        return df.withColumn(out, F.coalesce((low != high).cast("int"), F.lit(0)))
    marked = attach_stats(df, list(keys), __lo=low, __hi=high)
    return marked.withColumn(out, F.coalesce((F.col("__lo") != F.col("__hi")).cast("int"), F.lit(0))).drop(
        "__lo", "__hi")


def longest_list(df: DataFrame, keys: Sequence[str], items: str) -> DataFrame:
    """Distinct (keys, list) rows whose list is the longest of the group, ties kept."""
    return _longest(df, list(keys), items)[0]


def _longest(df: DataFrame, keys: list[str], items: str) -> tuple[DataFrame, DataFrame | None]:
    """The longest lists and the hot keys of ``df``. Rows are reduced to distinct lists, which are written, once."""
    lists = checkpointed(df.groupBy(*keys, items).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__len", F.coalesce(F.size(items), F.lit(0))))
    stats, hot = written_stats(lists.groupBy(*keys).agg(F.max("__len").alias("__best"), F.sum("__n").alias("__rows")), keys)
    # a group has at most as many lists as rows
    best = salted_join(lists, stats, keys, "inner", null_safe=True, check=False, hot=hot)
    return best.filter(F.col("__len") == F.col("__best")).drop("__len", "__best", "__n"), hot


def with_longest_list(df: DataFrame, rows: DataFrame, keys: Sequence[str], items: str) -> DataFrame:
    """``rows`` with the longest lists that their group has in ``df``, one row for each; none leaves the list empty.

    ``df`` holds every row of ``rows`` at least once, so the rows of its keys say which are hot.
    """
    longest, hot = _longest(df, list(keys), items)
    return salted_join(rows, longest.filter(F.col(items).isNotNull()), list(keys), "left", check=False, hot=hot)
