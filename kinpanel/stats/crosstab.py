"""Cross-tabulation, chi-square and Welch t from one pass of counts and moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.functions.expressions import plain_number
from kinpanel.functions.special import chi_square_p, t_p


def long_classes(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(variable, level, class) rows with neither missing. Widened in the scan; partial counts run before any shuffle."""
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])
    return (df.filter(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("class"), F.explode(parts).alias("p"))
            .select("p.variable", "p.level", "class").filter(F.col("level").isNotNull()))


def class_counts(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(variable, level, class, n): the only pass over the rows."""
    return long_classes(df, by, columns).groupBy("variable", "level", "class").agg(F.count(F.lit(1)).alias("n"))


def _with_total(counts: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    totals = counts.groupBy(*[F.col(k).alias(f"__{out}_{k}") for k in keys]).agg(F.sum("n").alias(out))
    cond = [counts[k] == totals[f"__{out}_{k}"] for k in keys]
    return counts.join(totals, cond).drop(*[f"__{out}_{k}" for k in keys])


def chi_square(counts: DataFrame, correct: bool = False) -> DataFrame:
    """(variable, statistic, df, p) from (variable, level, class, n); ``correct`` applies the 2 x 2 continuity correction.

    Sum of O²/E - N, so absent cells need no rows. For 2 x 2 all four |O - E| are equal, so any cell gives the corrected
    statistic.
    """
    cells = _with_total(_with_total(_with_total(counts, ["variable"], "all"), ["variable", "level"], "row"),
                        ["variable", "class"], "col")
    n, total, row, col = (F.col(c).cast("double") for c in ("n", "all", "row", "col"))
    expected = row * col / total
    # 1 / row total once per level: a level's cells share it in proportion to their counts
    per_variable = cells.groupBy("variable").agg(
        (F.sum(n * n / expected) - F.max(total)).alias("plain"), F.max(total).alias("total"),
        F.countDistinct("level").alias("r"), F.countDistinct("class").alias("c"),
        F.max(F.abs(n - expected)).alias("gap"),
        F.sum(n / row / row).alias("rows"), F.sum(n / col / col).alias("cols"))
    gap = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    corrected = gap * gap * F.col("total") * F.col("rows") * F.col("cols")
    statistic = F.col("plain")
    if correct:
        statistic = F.when((F.col("r") == 2) & (F.col("c") == 2), corrected).otherwise(statistic)
    return per_variable.select("variable", F.greatest(statistic, F.lit(0.0)).alias("statistic"),
                               ((F.col("r") - 1) * (F.col("c") - 1)).alias("df")).withColumn(
        "p", chi_square_p(F.col("statistic"), F.col("df").cast("double")))


def class_moments(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(variable, class, n, mean, variance) for numeric columns."""
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = (df.filter(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("class"), F.explode(parts).alias("p"))
            .select("class", "p.variable", "p.v").filter(F.col("v").isNotNull()))
    return rows.groupBy("variable", "class").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))


def welch_t(moments: DataFrame, first: str, second: str) -> DataFrame:
    """(variable, t, df, p) of the two-sample t-test without equal variances, first class minus second."""
    def at(value: str, level: str) -> Column:
        return F.max(F.when(F.col("class") == level, F.col(value).cast("double")))

    sides = moments.groupBy("variable").agg(*[
        at(v, level).alias(f"{v}{i}") for i, level in enumerate((first, second)) for v in ("n", "mean", "variance")])
    a, b = (F.col(f"variance{i}") / F.col(f"n{i}") for i in (0, 1))
    t = F.try_divide(F.col("mean0") - F.col("mean1"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))
    return sides.select("variable", t.alias("t"), df.alias("df")).withColumn("p", t_p("t", "df"))


def summary_crosstab(df: DataFrame, by: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(variable, level, class, text): ``n (column %)`` per level, ``mean (sd)`` per numeric variable, and class ``Total``.

    Totals come from the class counts and moments, not from the rows again.
    """
    parts = []
    if categorical:
        counts = class_counts(df, by, categorical)
        total = counts.groupBy("variable", "level").agg(F.sum("n").alias("n")).withColumn("class", F.lit("Total"))
        whole = _with_total(counts.unionByName(total), ["variable", "class"], "col")
        parts.append(whole.select("variable", "level", "class", F.concat(
            F.col("n").cast("string"), F.lit(" ("), plain_number(F.col("n") * 100.0 / F.col("col"), 1), F.lit(")")).alias("text")))
    if numeric:
        moments = class_moments(df, by, numeric)
        # moments has one row per variable and class
        n, gap = F.col("n"), F.col("mean") - F.col("grand")
        grand = F.sum(n * F.col("mean")).over(Window.partitionBy("variable")) / F.sum(n).over(Window.partitionBy("variable"))
        pooled = moments.withColumn("grand", grand).groupBy("variable").agg(
            F.sum("n").alias("n"), F.max("grand").alias("mean"),
            (F.sum(F.coalesce(F.col("variance"), F.lit(0.0)) * (n - 1) + n * gap * gap) / (F.sum("n") - 1)).alias("variance"))
        both = moments.unionByName(pooled.withColumn("class", F.lit("Total")))
        parts.append(both.select("variable", F.lit("Mean (SD)").alias("level"), "class", F.concat(
            plain_number(F.col("mean"), 1), F.lit(" ("), plain_number(F.sqrt("variance"), 1), F.lit(")")).alias("text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary_with_tests(df: DataFrame, by: str, categorical: Sequence[str], numeric: Sequence[str],
                       classes: tuple[str, str]) -> DataFrame:
    """``summary_crosstab`` with the p-value of the variable's test beside every row of it."""
    tests = crosstab_tests(df, by, categorical, numeric, classes)
    # one row per variable
    return summary_crosstab(df, by, categorical, numeric).join(tests, "variable", "left")


def crosstab_tests(df: DataFrame, by: str, categorical: Sequence[str], numeric: Sequence[str],
                   classes: tuple[str, str]) -> DataFrame:
    """(variable, p): chi-square for categorical variables, Welch t for numeric ones."""
    cat = chi_square(class_counts(df, by, categorical)).select("variable", "p")
    num = welch_t(class_moments(df, by, numeric), *classes).select("variable", "p")
    return cat.unionByName(num)
