"""All queries of the engine outside the optional subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import code_queries, retrieval_queries, session_queries, text_queries  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_context"](spark, sf_dir)
