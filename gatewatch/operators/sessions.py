"""Appearance sessions, recurrence rankings and track generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plates as P


def with_session(rows: DataFrame, key: str, gap_seconds: float, at: str = "created_at", camera: str | None = "camera_id", order: str = "detection_id") -> DataFrame:
    """Numbers each key's sessions from 1: a new one starts after a longer gap, and at another camera."""
    w = Window.partitionBy(key).orderBy(at, order)
    gap = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 1e6 > gap_seconds
    fresh = gap if camera is None else gap | ~F.col(camera).eqNullSafe(F.lag(camera).over(w))
    return rows.withColumn("_new", F.when(F.lag(at).over(w).isNull() | fresh, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(rows: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """One row a session: key, session, start, end, camera and detections."""
    numbered = with_session(rows.filter(F.col("created_at").isNotNull()), key, gap_seconds)
    return numbered.groupBy(key, "session").agg(F.min("created_at").alias("start_time"), F.max("created_at").alias("end_time"), F.min("camera_id").alias("camera_id"), F.count("*").alias("detections"))


def vehicle_recurrence(detections: DataFrame, plates: DataFrame, gap_seconds: float = 90.0, at_least: int = 2, history: int = 20) -> DataFrame:
    """Vehicles by valid plate that came back: sessions, detections, status, last seen and the newest sessions."""
    numbers = plates.select("plate_number").distinct()  # each is corrected once
    numbers = numbers.withColumn("plate", F.when(P.is_vehicle_plate(F.col("plate_number")), P.canonical(F.col("plate_number")))).filter("plate is not null")
    known = detections.filter("object_type = 'vehicle'").join(plates.select("plate_id", "plate_number").join(numbers, "plate_number"), "plate_id")
    by_session = sessions(known, "plate", gap_seconds)
    kind = F.coalesce(F.max_by(F.when(F.col("vehicle_type") != "unknown", F.col("vehicle_type")), F.when(F.col("vehicle_type") != "unknown", F.struct("created_at", "detection_id"))), F.lit("unknown"))
    facts = known.groupBy("plate").agg(F.count("*").alias("detection_count"), kind.alias("vehicle_type"))
    place = F.row_number().over(Window.partitionBy("plate").orderBy(F.desc("end_time"), F.desc("camera_id"), F.desc("session")))
    recent = F.when(F.col("place") <= history, F.struct("end_time", "camera_id", "detections"))  # null is not collected
    newest = F.sort_array(F.collect_list(recent), asc=False)
    ranked = by_session.withColumn("place", place).groupBy("plate").agg(F.count("*").alias("occurrence_count"), F.max("end_time").alias("last_seen"), F.max_by("camera_id", "session").alias("last_camera"), newest.alias("history"))
    return ranked.filter(F.col("occurrence_count") >= at_least).join(facts, "plate").withColumn("status", P.vehicle_recurrence(F.col("occurrence_count"), F.lit(True)))


def most_recurrent(vehicles: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` vehicles, 1 to 200, by how often they came, then by when they came last."""
    return vehicles.orderBy(F.desc("occurrence_count"), F.desc_nulls_last("last_seen"), "plate").limit(max(1, min(limit, 200)))


def person_recurrence(detections: DataFrame) -> DataFrame:
    """People by camera and identity: rows and last seen."""
    people = detections.filter("object_type = 'person'").withColumn("identity", P.person_identity(F.col("event_key"), F.col("track_id"))).filter("identity is not null")
    found = people.groupBy("camera_id", "identity").agg(F.count("*").alias("occurrence_count"), F.max("created_at").alias("last_seen"))
    return found.withColumn("status", P.person_recurrence(F.col("occurrence_count")))


def generations(rows: DataFrame, gap_seconds: float = 8.0) -> DataFrame:
    """A track's generation, from 0: one more after a gap of more than gap_seconds."""
    w = Window.partitionBy("camera_id", "track_id").orderBy("created_at", "detection_id")
    gap = (F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(w))) / 1e6
    return rows.withColumn("_new", F.when(gap > gap_seconds, 1).otherwise(0)).withColumn("generation", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def side_changes(rows: DataFrame) -> DataFrame:
    """Line crossings: rows whose side differs from the last known side of their track; 0 is on the line and unknown."""
    w = Window.partitionBy("camera_id", "track_id").orderBy("created_at", "detection_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("side") != 0, F.col("side"))
    return rows.withColumn("before", F.last(known, ignorenulls=True).over(w)).withColumn("crossed", F.coalesce((F.col("side") != 0) & (F.col("side") != F.col("before")), F.lit(False)))
