"""Queries over table changes, merges and report outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import plates as P
from ..functions import text as X
from ..operators import dedup, dml, merge, recording, reports
from ..sources import tables as T
from .aggregates import VALID_TEXT
from .shared import events, stamp

VALID = VALID_TEXT.replace("vote", "upper(text)")


def stored_readings(spark, sf):
    """Detections with plates as readings; a person's confidence is the face's, and of every three hashes two are near each other."""
    d = T.detections(spark, sf)
    rows = d.join(T.plates(spark, sf).select("plate_id", "plate_number", "ocr_confidence", "plate_crop_quality"), "plate_id", "left")
    return rows.selectExpr(
        "event_key", "detection_id as seq", "camera_id", "created_at", "case when detection_id % 3 > 0 then concat(substr(md5(cast(track_id % 7 as string)), 1, 14), substr(md5(cast(detection_id as string)), 1, 2)) end as hash",
        "plate_number as plate", "ocr_confidence as ocr", "detection_confidence as consensus", "plate_crop_quality as quality", "case when detection_id % 3 = 0 then null else detection_id % 3 = 1 end as stable",
        "object_type", "detection_confidence as face_confidence", "case when detection_id % 5 <> 0 then concat('face/', detection_id) end as face_image",
        "detection_confidence as vehicle_confidence", "detection_id % 17 = 0 as has_driver", "direction", "vehicle_type", "case when detection_id % 4 = 0 then concat('img/', detection_id) end as image",
    )


@query("sk01_merged_events")
def merged_events(spark, sf):
    """Readings folded into stored events: by key, by camera and plate within an hour, or skipped for their looks."""
    return recording.recorded(stored_readings(spark, sf), seconds=3_600)


@query("sk01_outcomes")
def outcomes(spark, sf):
    """What became of each reading."""
    return recording.outcomes(stored_readings(spark, sf), seconds=3_600)


@query("sk02_insert_cameras", "select camera_id, location, status, direction from cameras union all select 100 + camera_id, concat(location, ' B'), 1, case when direction in ('entry', 'exit', 'unknown') and camera_id % 2 = 0 then direction else 'unknown' end from cameras")
def insert_cameras(spark, sf):
    c = T.cameras(spark, sf)
    new = c.selectExpr("100 + camera_id as camera_id", "concat(location, ' B') as location", "1 as status", "case when camera_id % 2 = 0 then direction else 'sideways' end as direction")
    return dml.insert_cameras(c, new)


@query("sk03_update_camera", "select camera_id, case when camera_id = 3 then 'GATE 3' else location end as location, status, direction from cameras")
def update_camera(spark, sf):
    return dml.update_where(T.cameras(spark, sf), F.col("camera_id") == 3, location="GATE 3", direction=None)


@query("sk04_delete_camera", "select camera_id, case when camera_id = 4 then 0 else status end as status from cameras where camera_id <> 5")
def delete_camera(spark, sf):
    c = dml.update_where(T.cameras(spark, sf), F.col("camera_id") == 4, status=0)
    return dml.delete_where(c, F.col("camera_id") == 5).select("camera_id", "status")


@query("sk05_delete_detections", "select 'detections' as name, count(*) as n from detections where detection_id % 10 <> 0 union all select 'plates', count(*) from plates where plate_id % 10 <> 0 union all select 'logs', count(*) from plates where plate_id % 10 <> 0 and plate_id % 2 = 0")
def delete_detections(spark, sf):
    d, p = T.detections(spark, sf), T.plates(spark, sf)
    left = dml.delete_detections(d.filter("detection_id % 10 = 0").select("detection_id"), d, p, p.filter("plate_id % 2 = 0").select("plate_id"))
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in zip(("detections", "plates", "logs"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sk06_delete_plates", "select plate_id from plates where detection_status <> 0")
def delete_plates(spark, sf):
    p = T.plates(spark, sf)
    return dml.delete_plates(p.filter("detection_status = 0").select("plate_id"), p)[0].select("plate_id")


@query("sk07_settings", "select coalesce(o.key, n.key) as key, coalesce(n.value, o.value) as value from (select location as key, direction as value from cameras where camera_id < 20) o full join (select location as key, concat('v', max(camera_id)) as value from cameras where camera_id >= 10 group by 1) n on o.key = n.key")
def settings(spark, sf):
    c = T.cameras(spark, sf)
    changes = c.filter("camera_id >= 10").selectExpr("location as key", "'old' as value", "0L as seq").unionAll(c.filter("camera_id >= 10").selectExpr("location as key", "concat('v', camera_id) as value", "camera_id as seq"))
    return dml.upsert_settings(c.filter("camera_id < 20").selectExpr("location as key", "direction as value"), changes)


@query("sk08_zones", "select camera_id, '[[0.1,0.1],[0.9,0.1],[0.5,0.9]]' as mid_zone, case when camera_id % 2 = 0 then '[[0.2,0.2],[0.4,0.2],[0.3,0.4]]' end as near_zone from cameras")
def zones(spark, sf):
    """Zones parsed from JSON, upserted and written as JSON again."""
    c = T.cameras(spark, sf)
    stored = c.selectExpr("camera_id", "'[[0.1,0.1],[0.9,0.1],[0.5,0.9]]' as mid_zone", "cast(null as string) as near_zone")
    new = c.filter("camera_id % 2 = 0").selectExpr("camera_id", "cast(null as string) as mid_zone", "'[[0.2,0.2],[0.4,0.2],[0.3,0.4]]' as near_zone", "1 as seq")
    parsed = dml.zones_from_json(merge.upsert(stored, new, "camera_id"))
    return parsed.select("camera_id", F.to_json("mid_zone").alias("mid_zone"), F.to_json("near_zone").alias("near_zone"))


@query("sk09_retries", "select detection_id, case when detection_id % 3 = 0 then detection_id % 5 else 0 end + case when detection_id % 4 = 0 then 1 else 0 end as retries from detections")
def retries(spark, sf):
    d = T.detections(spark, sf).selectExpr("detection_id", "case when detection_id % 3 = 0 then detection_id % 5 end as retries")
    return dml.count_retries(d, d.filter("detection_id % 4 = 0"))


@query("sk10_event_keys", "select detection_id, case when trim(event_key) <> '' then event_key else concat('vehicle:', camera_id, ':det_', detection_id) end as event_key from detections")
def event_keys(spark, sf):
    return dml.with_event_key(T.detections(spark, sf)).select("detection_id", "event_key")


@query("sk11_evolved", "select detection_id, has_plate, 0 as retries, 'stream' as source_type from detections")
def evolved(spark, sf):
    d = T.detections(spark, sf).select("detection_id", "has_plate")
    return dml.evolve(d, {"retries": ("int", 0), "source_type": ("string", "stream"), "HAS_PLATE": ("int", 9)})


@query("sk12_unique_keys", "select detection_id, case when event_key is not null and row_number() over (partition by event_key order by detection_confidence desc, detection_id) > 1 then concat(event_key, '_dup', detection_id) else event_key end as event_key from detections")
def unique_keys(spark, sf):
    """SK-12 and JN-5: keys that repeat are told apart by a ranked update."""
    return dedup.disambiguate_keys(T.detections(spark, sf))


@query("sk13_direction_backfill", "select camera_id, case when contains(lower(location), 'masuk') then 'entry' when contains(lower(location), 'keluar') then 'exit' else direction end as direction from cameras")
def direction_backfill(spark, sf):
    return dml.direction_from_location(T.cameras(spark, sf)).select("camera_id", "direction")


@query("sk14_referenced", "select distinct concat('img/', detection_id % 100) as image from detections where detection_id % 2 = 0 and detection_id % 100 < 50")
def referenced(spark, sf):
    images = spark.range(50).selectExpr("concat('img/', id) as image")
    return dml.referenced(images, T.detections(spark, sf).filter("detection_id % 2 = 0").selectExpr("concat('img/', detection_id % 100) as image"))


@query("sk15_detection_report", "select row_number() over (order by created_at desc, detection_id desc) as no, camera_id, case detection_status when 1 then 'Terbaca' when 2 then 'Perlu Cek' else 'Gagal' end as status, round(detection_confidence * 100, 1) as keyakinan from dedup", events=True)
def detection_report(spark, sf):
    """All rows of the report, numbered from the newest on."""
    rows = reports.numbered(events(spark, sf), [F.desc("created_at"), F.desc("detection_id")])
    return rows.select("no", "camera_id", X.status_label(F.col("detection_status")).alias("status"), X.percent(F.col("detection_confidence")).alias("keyakinan"))


@query("sk16_payload")
def payload(spark, sf):
    """One JSON document of summary and hours."""
    from ..operators import analytics as A

    e = A.with_plates(events(spark, sf), T.plates(spark, sf))
    hours = A.hourly(e).agg(F.sort_array(F.collect_list(F.struct("hour", "label", "vehicles", "people"))).alias("hourly"))
    one = A.summary(e).select(F.struct("*").alias("summary"))
    return one.join(F.broadcast(hours)).select(F.to_json(F.struct("summary", "hourly")).alias("payload"))  # one row each


@query("sk17_rotated", "select detection_id as capture_id from (select detection_id, row_number() over (partition by camera_id order by created_at desc, detection_id desc) rn from detections) where rn <= 20")
def rotated(spark, sf):
    captures = T.detections(spark, sf).selectExpr("detection_id as capture_id", "camera_id as context", "created_at")
    return dml.rotate(captures, 20).select("capture_id")


@query("sk19_capture_paths", "select detection_id, concat(strftime(created_at, '%Y-%m-%d'), '/plate_cam', camera_id, '_', strftime(created_at, '%Y%m%d_%H%M%S'), '_', track_id, '.jpg') as path from detections")
def capture_paths(spark, sf):
    return T.detections(spark, sf).select("detection_id", X.capture_path("plate", F.col("camera_id"), F.col("created_at"), F.col("track_id")).alias("path"))


@query("sk20_first_sightings", "select detection_id from (select detection_id, direction, row_number() over w as rn, sum(case when direction <> 'unknown' then 1 else 0 end) over w as kn from detections window w as (partition by camera_id, track_id order by created_at, detection_id)) where rn = 1 or (direction <> 'unknown' and kn = 1)")
def first_sightings(spark, sf):
    return dml.first_and_known_direction(T.detections(spark, sf)).select("detection_id")


@query("sk21_finished_plates", f"select reading_id, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') as created_at from readings r join detections d on d.plate_id = r.reading_id where {VALID} or detection_confidence >= case when source_name like 'Video%' then 0.65 else 0.50 end")
def finished_plates(spark, sf):
    """Readings that are saved: valid ones, and those whose detection is sure enough, surer for videos than live."""
    d = T.detections(spark, sf).filter("plate_id is not null").selectExpr("plate_id as reading_id", "source_name", "detection_confidence")
    sure = F.col("detection_confidence") >= F.when(F.col("source_name").startswith("Video"), 0.65).otherwise(0.50)
    return T.readings(spark, sf).join(d, "reading_id").filter(P.is_valid(F.col("text")) | sure).select("reading_id", stamp())


@query("sk21_recorded_plates")
def recorded_plates(spark, sf):
    """SK-21 whole: finished plates with their vehicles, recorded as events."""
    frame = "cast(floor(id / 24) as bigint) as frame"
    plates = T.plate_boxes(spark, sf).filter("id % 3 = 0").selectExpr(frame, "camera_id % 2 as camera_id", "id", "vehicle_group", "vehicle as track", "generation", "x1", "y1", "x2", "y2", "text", "ocr", "ocr as consensus", "quality", "id % 2 = 0 as stable", "confidence as detection_confidence", "id % 5 = 0 as video", "created_at")
    vehicles = T.sightings(spark, sf).filter("id % 3 <> 0").selectExpr(frame, "camera_id % 2 as camera_id", "id", "person_group as vehicle_group", "track", "id % 2 + 1 as generation", "x1", "y1", "x2 + 120 as x2", "y2 + 80 as y2", "concat('vehicle:', camera_id % 2, ':', track) as event_key", "'car' as vehicle_type", "0.5D as confidence")
    readings = recording.finished_readings(plates.withColumn("valid", P.is_valid(F.col("text"))), vehicles)
    return recording.recorded(readings, seconds=43_200)


@query("sk18_report_names", "select camera_id, concat('laporan_', regexp_replace(trim(location), '[^A-Za-z0-9._-]+', '_', 'g'), '_20240120.csv') as name from cameras")
def report_names(spark, sf):
    return T.cameras(spark, sf).select("camera_id", F.concat(F.lit("laporan_"), X.safe_file_name(F.col("location")), F.lit("_"), F.date_format(F.lit("2024-01-20").cast("date"), "yyyyMMdd"), F.lit(".csv")).alias("name"))


@query("sk15_plate_report", "select plate_id, case when plate_number <> '' then plate_number else '-' end as plat, case detection_status when 1 then 'Terbaca' when 2 then 'Perlu Cek' else 'Gagal' end as status, round(ocr_confidence * 100, 1) as keyakinan from plates")
def plate_report(spark, sf):
    return reports.plates(T.plates(spark, sf))


@query("sk15_camera_report", "select camera_id, location as lokasi, case when status = 1 then 'Aktif' else 'Nonaktif' end as status, concat(upper(substr(direction, 1, 1)), substr(direction, 2)) as arah from cameras")
def camera_report(spark, sf):
    return reports.cameras(T.cameras(spark, sf))


@query("sk15_recap_report", "select coalesce(max(source_name), max(location), concat('CCTV-', camera_id)) as camera, count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'person') as people, count(*) as total from ev left join cameras c using (camera_id) group by camera_id", events=True)
def recap_report(spark, sf):
    return reports.recap(_events(spark, sf), T.cameras(spark, sf))


@query("sk15_statistics_report", "select count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'person') as people, count(distinct case when plate_number <> '' then plate_number end) as unique_plates, cast(floor(round(count_if(plate_status = 1) * 100.0 / nullif(count_if(plate_status is not null), 0), 1) + 0.5) as bigint) as read_rate from ev", events=True)
def statistics_report(spark, sf):
    return reports.statistics(_events(spark, sf))


def _events(spark, sf):
    from ..operators import analytics

    return analytics.with_plates(events(spark, sf), T.plates(spark, sf))
