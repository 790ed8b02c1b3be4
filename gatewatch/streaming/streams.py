"""Streams of detections: sources, windowed counts, de-duplication, late enrichment and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources import tables as T
from . import late


def _events(spark: SparkSession, sf_dir: str, files_per_trigger: int) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    single = any(f.endswith("/events.parquet") for f in table.inputFiles())  # a stream reads folders: a file is picked from its own
    raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return raw.selectExpr(*[f"{e} as {n}" for n, e in T.BASE.items()])


def detections(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8, delay: str = "10 minutes") -> DataFrame:
    """The events files as a stream of detections with a watermark; the rate is bounded, nothing is dropped for it (SC-10, SC-12, SS-15, SS-16)."""
    rows = _events(spark, sf_dir, files_per_trigger).selectExpr(*[f"{e} as {n}" for n, e in T.DETECTIONS.items()])
    return rows.withWatermark("created_at", delay)


def boxed(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8, delay: str = "10 minutes") -> DataFrame:
    """The stream of detections with their boxes."""
    both = T.BOXES | T.DETECTIONS
    return _events(spark, sf_dir, files_per_trigger).selectExpr(*[f"{e} as {n}" for n, e in both.items()]).withWatermark("created_at", delay)


def plate_boxes(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8, delay: str = "10 minutes") -> DataFrame:
    """The stream of plate boxes with what reading them gives."""
    return _events(spark, sf_dir, files_per_trigger).selectExpr(*[f"{e} as {n}" for n, e in T.PLATE_BOXES.items()]).withWatermark("created_at", delay)


def sightings(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8, delay: str = "10 minutes") -> DataFrame:
    """The stream of people and vehicles with box, track, group and look."""
    return _events(spark, sf_dir, files_per_trigger).selectExpr(*[f"{e} as {n}" for n, e in T.SIGHTINGS.items()]).withWatermark("created_at", delay)


def readings(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8, delay: str = "10 minutes") -> DataFrame:
    """The stream of plate readings."""
    rows = _events(spark, sf_dir, files_per_trigger).filter("k % 4 <> 3 and event_type <> 'error'")
    for spec in (T.PLATES, T.READINGS):
        rows = rows.selectExpr(*[f"{e} as {n}" for n, e in spec.items()])
    return rows.withWatermark("created_at", delay)


def counts(rows: DataFrame, length: str = "1 hour") -> DataFrame:
    """Vehicles and people by camera and tumbling window, given out when the watermark has passed the window."""
    w = F.window("created_at", length)
    found = rows.groupBy(w.alias("w"), "camera_id").agg(F.count_if(F.col("object_type") == "vehicle").alias("vehicles"), F.count_if(F.col("object_type") == "person").alias("people"))
    return found.select(F.col("w.start").alias("start"), "camera_id", "vehicles", "people")


def first_of_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's delay (SS-9 for exact keys, with SS-13's expiry)."""
    return rows.dropDuplicatesWithinWatermark(keys)


def every_nth_frame(rows: DataFrame, n: int = 3) -> DataFrame:
    """SS-17."""
    return rows.filter(F.pmod(F.col("detection_id"), F.lit(n)) == 1)


def newest_of_camera(batch: DataFrame) -> DataFrame:
    """SS-14: of each camera the newest row of a micro-batch."""
    return batch.groupBy("camera_id").agg(F.max_by(F.struct("*"), F.struct("created_at", "detection_id")).alias("r")).select("r.*")


def late_plates(vehicles: DataFrame, plates: DataFrame, seconds: int = 120) -> DataFrame:
    """SS-11: vehicles with the plates that were read up to `seconds` after them, and vehicles without one once that time has passed.

    Both sides carry watermarks, so the state is bounded. A join of two streams would compare all rows of a key that are in its state, which a
    micro-batch may fill with any length of time, and hold each as a row: `late` finds a vehicle's plates in sorted arrays."""
    # pandas knows no times after 2262: the watermark's column ends there, `at` does not
    bounded = lambda rows: rows.filter("created_at is not null").withColumn("at", F.expr("unix_micros(created_at)")).withColumn(
        "created_at", F.expr("least(created_at, timestamp'2262-01-01')").alias("created_at", metadata=rows.schema["created_at"].metadata)
    )
    v = bounded(vehicles).selectExpr("camera_id", "track_id", "created_at", "at", "cast(coalesce(detection_id, 0) as bigint) as id", "detection_id is null as nameless", "false as plate")
    # plates without a camera or a track number are no vehicle's
    p = bounded(plates.filter("camera_id is not null and track_id is not null")).selectExpr("camera_id", "track_id", "created_at", "at", "cast(plate_id as bigint) as id", "false as nameless", "true as plate")
    found = v.unionByName(p).groupBy("camera_id", "track_id").applyInPandasWithState(late.follow(seconds), late.FOUND, late.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.mapInArrow(late.told, "vehicle long, reading long")


def each_batch(rows: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """SS-19: hands every micro-batch to `apply`, which must be idempotent for a batch's number, as a batch may be repeated."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
