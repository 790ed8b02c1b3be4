"""Queries over window functions, sessions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import dedup, sessions
from ..sources import tables as T
from .shared import events, stamp

GAP = 43_200


@query("wn01_event_dedup", "select detection_id, camera_id, event_key, detection_confidence from dedup", events=True)
def event_dedup(spark, sf):
    return events(spark, sf).select("detection_id", "camera_id", "event_key", "detection_confidence")


@query("wn02_recent_dedup", "select detection_id from (select *, row_number() over (partition by camera_id, coalesce(event_key, concat('det:', detection_id)) order by coalesce(detection_confidence, 0) desc, created_at desc, detection_id desc) rn from detections) where rn = 1")
def recent_dedup(spark, sf):
    return dedup.best_recent(T.detections(spark, sf)).select("detection_id")


@query("wn03_greedy_plates")
def greedy_plates(spark, sf):
    """One reading a passage (window of six hours, so that the sparse events meet)."""
    d = T.detections(spark, sf).select("plate_id", "camera_id", "event_key")
    rows = T.plates(spark, sf).join(d, "plate_id").withColumnRenamed("plate_crop_quality", "quality")
    return dedup.greedy_plates(rows, 21_600)


SESSIONS = f""", v as (select d.detection_id, d.camera_id, d.created_at, p.plate_number as plate from detections d join plates p using (plate_id) where object_type = 'vehicle'),
s as (select *, sum(fresh) over (partition by plate order by created_at, detection_id) as session from (select *, case when lag(created_at) over w is null or epoch(created_at) - epoch(lag(created_at) over w) > {GAP} or camera_id <> lag(camera_id) over w then 1 else 0 end as fresh from v window w as (partition by plate order by created_at, detection_id)))
"""


def _vehicles(spark, sf):
    return T.detections(spark, sf).filter("object_type = 'vehicle'").join(T.plates(spark, sf).selectExpr("plate_id", "plate_number as plate"), "plate_id")


@query("wn04_sessions", SESSIONS + "select plate, cast(session as bigint) as session, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as start_time, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as end_time, min(camera_id) as camera_id, count(*) as detections from s group by plate, session")
def appearance_sessions(spark, sf):
    found = sessions.sessions(_vehicles(spark, sf), "plate", GAP)
    return found.withColumns({"start_time": stamp("start_time"), "end_time": stamp("end_time")})


@query("ag12_vehicle_recurrence", SESSIONS + "select plate, count(distinct session) as occurrence_count, count(*) as detection_count, case when count(distinct session) <= 5 then 'SERING_MUNCUL' else 'MENCURIGAKAN' end as status, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen from s group by plate having count(distinct session) >= 2")
def vehicle_recurrence(spark, sf):
    found = sessions.vehicle_recurrence(T.detections(spark, sf), T.plates(spark, sf), GAP)
    return found.select("plate", "occurrence_count", "detection_count", "status", stamp("last_seen"))


@query("sl04_most_recurrent", SESSIONS + "select plate, count(distinct session) as occurrence_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen from s group by plate having count(distinct session) >= 2 order by occurrence_count desc, max(created_at) desc, plate limit 200")
def most_recurrent(spark, sf):
    """SL-4: the 200 vehicles that came most often."""
    found = sessions.most_recurrent(sessions.vehicle_recurrence(T.detections(spark, sf), T.plates(spark, sf), GAP), 1000)
    return found.select("plate", "occurrence_count", stamp("last_seen"))


@query("wn08_recurrence_history", SESSIONS + """, q as (select plate, session, min(camera_id) as cam from s group by 1, 2), f as (select plate, count(*) as n, arg_max(cam, session) as last_camera from q group by 1 having count(*) >= 2),
t as (select plate_number as plate, coalesce(arg_max(vehicle_type, row(d.created_at, d.detection_id)) filter (where vehicle_type <> 'unknown'), 'unknown') as vehicle_type from detections d join plates p using (plate_id) where object_type = 'vehicle' group by 1)
select plate, vehicle_type, last_camera, cast(least(20, n) as int) as n_history from f join t using (plate)""")
def recurrence_history(spark, sf):
    found = sessions.vehicle_recurrence(T.detections(spark, sf), T.plates(spark, sf), GAP)
    return found.select("plate", "vehicle_type", "last_camera", F.size("history").alias("n_history"))


@query("ag13_person_recurrence", "select camera_id, case when event_key is null or trim(event_key) = '' then concat('track:', track_id) else concat('track:', track_id) end as identity, count(*) as occurrence_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen, case when count(*) = 1 then 'NORMAL' when count(*) between 2 and 5 then 'SERING_MUNCUL' else 'MENCURIGAKAN' end as status from detections where object_type = 'person' group by 1, 2")
def person_recurrence(spark, sf):
    return sessions.person_recurrence(T.detections(spark, sf)).withColumn("last_seen", stamp("last_seen"))


@query("wn05_row_numbers", "select detection_id, row_number() over (partition by camera_id order by created_at desc, detection_id desc) as no from detections")
def row_numbers(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("camera_id").orderBy(F.desc("created_at"), F.desc("detection_id"))
    return T.detections(spark, sf).select("detection_id", F.row_number().over(w).alias("no"))


@query("wn06_generations", "select detection_id, cast(sum(fresh) over (partition by camera_id, track_id order by created_at, detection_id) as bigint) as generation from (select *, case when epoch(created_at) - epoch(lag(created_at) over (partition by camera_id, track_id order by created_at, detection_id)) > 86400 then 1 else 0 end as fresh from detections)")
def generations(spark, sf):
    return sessions.generations(T.detections(spark, sf), 86_400).select("detection_id", "generation")


@query("wn07_first_and_last", "select camera_id, arg_max(source_name, row(created_at, detection_id)) filter (source_name is not null) as last_source, arg_min(vehicle_type, row(created_at, detection_id)) filter (vehicle_type <> 'unknown') as first_type from detections group by 1")
def first_and_last(spark, sf):
    at = F.struct("created_at", "detection_id")
    known = F.col("vehicle_type") != "unknown"
    return T.detections(spark, sf).groupBy("camera_id").agg(
        F.max_by("source_name", F.when(F.col("source_name").isNotNull(), at)).alias("last_source"), F.min_by("vehicle_type", F.when(known, at)).alias("first_type")
    )


@query("wn09_side_changes", "select detection_id, before, coalesce(side <> 0 and side <> before, false) as crossed from (select *, last_value(case when side <> 0 then side end ignore nulls) over (partition by camera_id, track_id order by created_at, detection_id rows between unbounded preceding and 1 preceding) as before from (select *, cast(detection_id % 3 as int) - 1 as side from detections))")
def side_changes(spark, sf):
    rows = T.detections(spark, sf).withColumn("side", (F.col("detection_id") % 3).cast("int") - 1)
    return sessions.side_changes(rows).select("detection_id", "before", "crossed")


@query("st01_difference", "select distinct camera_id from detections except select camera_id from cameras where status = 1")
def difference(spark, sf):
    return T.detections(spark, sf).select("camera_id").distinct().subtract(T.cameras(spark, sf).filter("status = 1").select("camera_id"))


@query("st02_known_regions", "select regexp_extract(plate_number, '^[A-Z]+', 0) as region, count(*) as n from plates where regexp_extract(plate_number, '^[A-Z]+', 0) in ('B', 'D', 'AB') group by 1")
def known_regions(spark, sf):
    from ..functions.plates import known_region

    rows = T.plates(spark, sf).withColumn("region", F.regexp_extract("plate_number", "^[A-Z]+", 0))
    return rows.filter(known_region(F.col("region"))).groupBy("region").agg(F.count("*").alias("n"))


@query("st03_distinct", "select distinct camera_id, track_id from detections")
def distinct(spark, sf):
    return T.detections(spark, sf).select("camera_id", "track_id").dropDuplicates()


@query("st04_concatenation", "select plate_id as id, plate_number as text from plates where detection_status = 1 union all select plate_id, plate_number from plates where detection_status = 2")
def concatenation(spark, sf):
    rows = T.plates(spark, sf).selectExpr("plate_id as id", "plate_number as text", "detection_status as s")
    return rows.filter("s = 1").unionByName(rows.filter("s = 2")).drop("s")


@query("sl05_person_order", "select * from (select camera_id, concat('track:', track_id) as identity, count(*) as n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen from detections where object_type = 'person' group by 1, 2) order by n, last_seen desc, camera_id, identity limit 50")
def person_order(spark, sf):
    found = sessions.person_recurrence(T.detections(spark, sf)).orderBy("occurrence_count", F.desc("last_seen"), "camera_id", "identity").limit(50)
    return found.select("camera_id", "identity", F.col("occurrence_count").alias("n"), stamp("last_seen"))
