"""The library's queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from advisorium.plans import audit_queries, body_queries, catalogue_queries, cleaning_queries, matching_queries, more_queries, page_queries, record_queries, state_queries, stream_queries, text_queries
from advisorium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "body_queries", "catalogue_queries", "cleaning_queries", "flagship", "matching_queries", "more_queries", "page_queries", "state_queries", "stream_queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletin cards by product."""
    return record_queries.product_cards(spark, sf_dir)
