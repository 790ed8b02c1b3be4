"""What the queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, dedup
from ..sources import tables


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated detections."""
    return dedup.best_per_event(tables.detections(spark, sf_dir))


def events_with_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.with_plates(events(spark, sf_dir), tables.plates(spark, sf_dir))


def stamp(column: str = "created_at") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)
