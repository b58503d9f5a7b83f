"""Classification metrics and exact ROC AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.operators.ordering import running_totals


def rates_of(predicted: Column, actual: Column, weight: Column | None = None) -> dict[str, Column]:
    """Accuracy, precision and recall of an event from two boolean columns; NULL where the denominator is 0."""
    w = F.lit(1) if weight is None else weight

    def total(test: Column) -> Column:
        return F.sum(F.when(test, w).otherwise(0))

    hit = total(predicted & actual)
    return {"accuracy": F.try_divide(total(predicted == actual), F.sum(w)),
            "precision": F.try_divide(hit, total(predicted)),
            "recall": F.try_divide(hit, total(actual))}


def classification_metrics(df: DataFrame, truth: str, score: str, event: int = 0, threshold: float = 0.5,
                           groups: Sequence[str] = ()) -> DataFrame:
    """Metrics at a threshold on the score of class 1; precision and recall describe class ``event``.

    The default event is class 0: the first level of a 0/1 factor is the event.
    """
    rows = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    predicted = F.when(F.col(score) > threshold, 1).otherwise(0) == event
    rates = rates_of(predicted, F.col(truth) == event)
    return rows.groupBy(*groups).agg(*[c.alias(n) for n, c in rates.items()])


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half. Rows are reduced to distinct scores, then running totals in
    score buckets replace a sort of the whole table; the value is the same whichever class is the event."""
    counts = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(
        F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("neg"))
    ranked = running_totals(counts, [], score, ["neg"])
    below = F.col("before_neg").cast("double") + F.col("neg") / 2.0
    return ranked.agg(F.try_divide(
        F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))
