"""Nested specifications and their coefficient table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.functions.expressions import estimate_label, plain_number
from kinpanel.operators.reshape import to_wide


def nested_specifications(groups: Mapping[str, object], optional: Sequence[str] = ()) -> dict[str, list[str]]:
    """Specification name -> covariates, each adding one group to those before.

    A group is a name, a sequence of names added together, or a mapping of alternatives: each alternative is tried on
    its own, and the last one stays for the following groups. ``optional`` covariates are in every specification; the fit
    leaves out those with a single value.
    """
    current, out = list(optional), {}
    for name, group in groups.items():
        if isinstance(group, Mapping):
            for label, extra in group.items():
                added = [extra] if isinstance(extra, str) else list(extra)
                out[label] = [*current, *added]
            current = [*current, *added]
        else:
            current = [*current, *([group] if isinstance(group, str) else group)]
            out[name] = list(current)
    return out


def varying_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, varies): does the column hold more than one value, a missing value counting as one? One pass."""
    aggs = []
    for i, c in enumerate(columns):
        known = F.count(F.col(c))
        aggs.append(((F.min(c) != F.max(c)) | ((known > 0) & (known < F.count(F.lit(1))))).alias(f"v{i}"))
    flags = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(f"v{i}"), F.lit(False)).alias("varies"))
                      for i, c in enumerate(columns)])
    return flags.select(F.explode(pairs).alias("p")).select("p.name", F.col("p.varies").cast("int").alias("varies"))


def coefficient_rows(fitted: DataFrame, terms_like: Sequence[str]) -> DataFrame:
    """(subgroup, term, specification, text): estimates of the terms of interest and one nobs row per model."""
    keys = ["subgroup", "specification"]
    chosen = fitted.filter(F.col("term").rlike("|".join(terms_like))).select(
        *keys, "term", estimate_label(F.col("estimate"), F.col("std_error"), F.col("p_value")).alias("text"))
    sizes = fitted.groupBy(*keys).agg(F.max("nobs").alias("__n")).select(
        *keys, F.lit("nobs").alias("term"), plain_number(F.col("__n"), 0).alias("text"))
    label = F.concat(F.lit("+"), F.regexp_replace("specification", "_", " "))
    return chosen.unionByName(sizes).withColumn("specification", label)


def coefficient_table(fitted: DataFrame, terms_like: Sequence[str], specifications: Sequence[str]) -> DataFrame:
    """One row per (subgroup, term), one column per specification, in specification order."""
    labels = ["+" + s.replace("_", " ") for s in specifications]
    return to_wide(coefficient_rows(fitted, terms_like), ["subgroup", "term"], "specification", labels, F.first("text"))
