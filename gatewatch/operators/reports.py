"""Report tables and their files. Spreadsheet and page layout are left to whoever reads the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import cut
from . import analytics as A


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with `no`, from 1 in that order: ranges are numbered on their own and moved by the sizes of those before, so no task
    sees more than a range."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(starts, "_part").withColumn("no", (F.col("_start") + own).cast("long")).drop("_part", "_start")


def plates(history: DataFrame) -> DataFrame:
    """Plates: number, status and confidence in percent."""
    return history.select("plate_id", F.coalesce(F.nullif("plate_number", F.lit("")), F.lit("-")).alias("plat"), X.status_label(F.col("detection_status")).alias("status"), X.percent(F.col("ocr_confidence")).alias("keyakinan"))


def cameras(table: DataFrame) -> DataFrame:
    return table.select("camera_id", F.coalesce("location", F.lit("-")).alias("lokasi"), X.camera_status(F.col("status")).alias("status"), F.initcap("direction").alias("arah"))


def recap(events: DataFrame, cameras: DataFrame) -> DataFrame:
    """By camera: label, vehicles, people and their sum."""
    by = A.per_camera(events, cameras)
    return by.select("camera", "vehicles", "people", (F.col("vehicles") + F.col("people")).alias("total"))


def statistics(events: DataFrame) -> DataFrame:
    """One row: totals and the read rate as a whole percentage, halves rounded up."""
    rate = A.plate_performance(events).select(F.floor(F.coalesce("read_rate", F.lit(0)) + F.lit(0.5)).cast("long").alias("read_rate"))
    return A.summary(events).join(F.broadcast(rate)).select("vehicles", "people", "unique_plates", "read_rate")  # one row each


def write(report: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes a report as CSV with a header, JSON lines or Parquet; a failed run leaves no _SUCCESS."""
    writer = report.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.json if kind == "json" else writer.parquet)(path)
