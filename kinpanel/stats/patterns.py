"""Covariate patterns: the cluster-side reduction that every categorical model starts from.

Grouping rows by all categorical covariates loses nothing for a logit, and the result is bounded by the product of the
level counts however many rows there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def compress(df: DataFrame, y: str, levels: Mapping[str, Sequence[object]],
             subgroups: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per covariate pattern: covariates as text, ``successes`` and ``n``; rows with unknown y are left out.

    Values outside a covariate's level list become NULL, as for an ordered factor, so the bound holds. With
    ``subgroups`` (overlapping samples given as conditions) the table gets a column ``subgroup`` and one copy of a
    pattern per sample it belongs to; the copies are made after the reduction, not before.
    """
    subgroups = dict(subgroups or {})
    covariates = [
        F.when(F.col(x).cast("string").isin([str(v) for v in known]), F.col(x).cast("string")).alias(x)
        for x, known in levels.items()]
    flags = [F.coalesce(test, F.lit(False)).alias(f"__g{i}") for i, test in enumerate(subgroups.values())]
    rows = df.filter(F.col(y).isNotNull()).select(*covariates, *flags, F.col(y).cast("long").alias("__y"))
    keys = [*levels, *[f"__g{i}" for i in range(len(subgroups))]]
    out = rows.groupBy(*keys).agg(F.sum("__y").alias("successes"), F.count(F.lit(1)).alias("n"))
    if subgroups:
        member = F.array(*[F.when(F.col(f"__g{i}"), F.lit(name)) for i, name in enumerate(subgroups)])
        out = out.withColumn("subgroup", F.explode(F.array_compact(member))).drop(*[f"__g{i}" for i in range(len(subgroups))])
    return out
