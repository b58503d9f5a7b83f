"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinpanel.plans import expressions, groups, models, survey  # noqa: F401  (importing registers their queries)
from kinpanel.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders to the nested models of the household panel."""
    return survey.panel_models(spark, sf_dir)
