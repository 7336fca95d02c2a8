"""Everything that is registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactlens.plans import (  # noqa: F401
    dataset_queries,
    document_queries,
    labelling_queries,
    model_queries,
    text_queries,
)
from pactlens.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f1_label_counts"](spark, sf_dir)
