"""Values of columns that are read more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being evaluated once a row however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spread(rows: DataFrame, *key: str, least: int = 1) -> DataFrame:
    """rows dealt by a key over all cores, in at least so many tasks: a table in one small file would be one task, however much is made of each row."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)
    return rows.repartition(parts, *key)
