"""Changes to tables, as tables: inserts, updates, deletes that cascade, key-value upserts, schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAYS = ("entry", "exit", "unknown")


def insert_cameras(cameras: DataFrame, new: DataFrame) -> DataFrame:
    """New cameras; a direction that is none becomes unknown."""
    way = F.when(F.col("direction").isin(*WAYS), F.col("direction")).otherwise("unknown")
    return cameras.unionByName(new.withColumn("direction", way), allowMissingColumns=True)


def update_where(rows: DataFrame, condition: Column, **values) -> DataFrame:
    """Sets the values that are not None where the condition holds."""
    return rows.withColumns({k: F.when(condition, F.lit(v)).otherwise(F.col(k)) for k, v in values.items() if v is not None})


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def delete_detections(ids: DataFrame, detections: DataFrame, plates: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, plates and logs without the detections of ids and what only they refer to."""
    gone = detections.join(ids, "detection_id", "left_semi").select("plate_id").filter("plate_id is not null").distinct()
    return detections.join(ids, "detection_id", "left_anti"), plates.join(gone, "plate_id", "left_anti"), logs.join(gone, "plate_id", "left_anti")


def delete_plates(ids: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    return tuple(t.join(ids, "plate_id", "left_anti") for t in tables)


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: the last change (by seq) of each key wins over what was there."""
    last = changes.groupBy("key").agg(F.max_by("value", "seq").alias("new"))
    return settings.join(last, "key", "full_outer").select("key", F.coalesce("new", "value").alias("value"))


def settings_map(settings: DataFrame) -> DataFrame:
    return settings.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def zones_from_json(zones: DataFrame) -> DataFrame:
    polygon = "array<array<double>>"
    return zones.select("camera_id", F.from_json("mid_zone", polygon).alias("mid_zone"), F.from_json("near_zone", polygon).alias("near_zone"))


def count_retries(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """One more retry where detection_id failed; none yet counts as zero."""
    tried = rows.join(failed.select("detection_id", F.lit(1).alias("_one")).distinct(), "detection_id", "left")
    return tried.withColumn("retries", F.coalesce("retries", F.lit(0)) + F.coalesce("_one", F.lit(0))).drop("_one")


def with_event_key(detections: DataFrame) -> DataFrame:
    made = F.concat(F.lit("vehicle:"), F.col("camera_id").cast("string"), F.lit(":det_"), F.col("detection_id").cast("string"))
    return detections.withColumn("event_key", F.when(F.trim("event_key") != "", F.col("event_key")).otherwise(made))


def evolve(rows: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing, with their type and default."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in wanted.items() if c.lower() not in have})


def direction_from_location(cameras: DataFrame) -> DataFrame:
    place = F.lower("location")
    return cameras.withColumn("direction", F.when(place.contains("masuk"), "entry").when(place.contains("keluar"), "exit").otherwise(F.col("direction")))


def referenced(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Images that a detection still names."""
    return images.join(detections.select("image"), "image", "left_semi")


def rotate(captures: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` captures of each context."""
    w = Window.partitionBy("context").orderBy(F.desc("created_at"), F.desc("capture_id"))
    return captures.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).drop("rn")


def first_and_known_direction(detections: DataFrame) -> DataFrame:
    """Rows that are saved of each track: its first, and the first whose direction is known if that came later."""
    w = Window.partitionBy("camera_id", "track_id").orderBy("created_at", "detection_id")
    known = F.col("direction") != "unknown"
    rows = detections.withColumn("rn", F.row_number().over(w)).withColumn("n_known", F.sum(known.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("rn") == 1) | known & (F.col("n_known") == 1)).drop("rn", "n_known")
