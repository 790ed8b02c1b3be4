"""De-duplication of events: by key, by time order within a camera and plate, and by look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def event_identity() -> Column:
    """The key of an event if it is not blank, else its own id."""
    key = F.col("event_key")
    return F.when(key.isNotNull() & (F.trim(key) != ""), F.concat(F.lit("event:"), key)).otherwise(F.concat(F.lit("det:"), F.col("detection_id").cast("string")))


def best_per_event(detections: DataFrame) -> DataFrame:
    """The most confident row of each camera's event, the later id on ties. Filter before: filters belong below the ranking."""
    best = detections.groupBy("camera_id", event_identity().alias("_key")).agg(F.max_by(F.struct("*"), F.struct(F.coalesce("detection_confidence", F.lit(-1.0)), "detection_id")).alias("r"))
    return best.select("r.*")


def best_recent(detections: DataFrame) -> DataFrame:
    """As best_per_event, but ties go to the newest row, and a key of white space is a key."""
    key = F.coalesce("event_key", F.concat(F.lit("det:"), F.col("detection_id").cast("string")))
    order = F.struct(F.coalesce("detection_confidence", F.lit(0.0)), "created_at", "detection_id")
    return detections.groupBy("camera_id", key.alias("_key")).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def greedy_plates(plates: DataFrame, window_seconds: int = 25) -> DataFrame:
    """One reading a passage: best readings first, each is kept unless a kept one has its plate and camera within
    window_seconds, or its camera and event key. Returns the plate_ids kept.

    What is kept depends on what was kept before. A reading that is the best of all undecided ones in its time window and of its
    event key is kept in the sequential order as well, whatever the others turn out to be; all that conflict with it are not.
    Deciding these in rounds gives the sequential result with windows only, and no camera meets in one task."""
    number = F.upper(F.trim(F.coalesce("plate_number", F.lit(""))))
    rank = F.struct(F.coalesce("ocr_confidence", F.lit(-1.0)).alias("ocr"), F.coalesce("quality", F.lit(-1.0)).alias("quality"), "created_at", "plate_id")
    plate = F.when(~number.isin("", "-"), number).otherwise(F.concat(F.lit("plate:"), F.col("plate_id").cast("string")))
    key = F.when(F.coalesce("event_key", F.lit("")) != "", F.concat(F.lit("event:"), "event_key")).otherwise(F.concat(F.lit("plate:"), F.col("plate_id").cast("string")))
    open_ = plates.select("plate_id", "camera_id", plate.alias("plate"), key.alias("key"), F.unix_micros("created_at").alias("at"), rank.alias("rank"))
    near = Window.partitionBy("camera_id", "plate").orderBy("at").rangeBetween(-window_seconds * 1_000_000, window_seconds * 1_000_000)
    same = Window.partitionBy("camera_id", "key")
    kept = None
    while True:
        best = open_.withColumn("keep", (F.max("rank").over(near) == F.col("rank")) & (F.max("rank").over(same) == F.col("rank")))
        decided = cut(best.withColumn("gone", ~F.col("keep") & (F.max("keep").over(near) | F.max("keep").over(same))))
        chosen = decided.filter("keep").select("plate_id")
        kept = chosen if kept is None else kept.unionByName(chosen)
        open_ = decided.filter("not keep and not gone").drop("keep", "gone")
        if open_.isEmpty():
            return kept


def disambiguate_keys(detections: DataFrame) -> DataFrame:
    """Event keys made unique: all but the most confident row of a key get `_dup` and their id."""
    w = Window.partitionBy("event_key").orderBy(F.desc_nulls_last("detection_confidence"), "detection_id")
    named = detections.filter(F.col("event_key").isNotNull()).withColumn("rn", F.row_number().over(w))
    unique = F.when(F.col("rn") > 1, F.concat("event_key", F.lit("_dup"), F.col("detection_id").cast("string"))).otherwise(F.col("event_key"))
    return named.select("detection_id", unique.alias("event_key")).unionByName(detections.filter(F.col("event_key").isNull()).select("detection_id", "event_key"))


def previous_match(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """As-of look-back: the newest earlier row of the same keys within `seconds`, as prior_id."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds("created_at")).rangeBetween(-seconds, -1)
    return rows.withColumn("prior_id", F.max(F.struct("created_at", "detection_id")).over(w)["detection_id"])
