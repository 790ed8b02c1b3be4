"""Queries over filters, pages and listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import joins as J
from ..operators import listing as L
from ..sources import tables as T
from .scalars import VOTED
from .shared import events, stamp

JOINED = "select d.*, c.location, p.plate_number, p.ocr_confidence, p.plate_crop_quality, coalesce(d.source_name, c.location, 'CCTV') as camera_name from detections d left join plates p using (plate_id) left join cameras c on d.camera_id = c.camera_id"
ROWS = f", rows_ as ({JOINED}) "


def _rows(spark, sf):
    return J.details(T.detections(spark, sf), T.plates(spark, sf), T.cameras(spark, sf))


@query("fl01_conditions", ROWS + "select detection_id from rows_ where created_at >= timestamp '2024-01-02' and created_at < timestamp '2024-01-29' and camera_id = 3 and contains(upper(coalesce(location, '')), '_3 MAS') and direction = 'entry' and object_type = 'vehicle'")
def conditions(spark, sf):
    return _rows(spark, sf).filter(L.conditions(date(2024, 1, 2), date(2024, 1, 28), 3, region="_3 mas", direction="entry", object_type="vehicle")).select("detection_id")


@query("fl02_last_week", "select count(*) as n, count(distinct camera_id) as cameras from detections where created_at >= timestamp '2024-01-14' and created_at < timestamp '2024-01-21'")
def last_week(spark, sf):
    _, first, last = L.period("7d", date(2024, 1, 20))
    return T.detections(spark, sf).filter(L.conditions(first, last)).agg(F.count("*").alias("n"), F.count_distinct("camera_id").alias("cameras"))


@query("fl03_yesterday", "select detection_id from detections where created_at >= timestamp '2024-01-19' and created_at < timestamp '2024-01-20'")
def yesterday(spark, sf):
    _, first, last = L.period("yesterday", date(2024, 1, 20))
    return T.detections(spark, sf).filter(L.conditions(first, last)).select("detection_id")


@query("fl05_listing_page", "select detection_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from detections where object_type = 'vehicle' and detection_status = 1 order by detections.created_at desc, detection_id desc limit 20 offset 40")
def listing_page(spark, sf):
    rows = T.detections(spark, sf).filter(L.conditions(object_type="vehicle", status=1))
    return L.page(rows, [F.desc("created_at"), F.desc("detection_id")], 3, 20).select("detection_id", stamp())


@query("fl06_readable", ROWS + "select detection_id from rows_ where detection_status = 1 and (has_plate <> 1 or ocr_confidence > 0)")
def readable(spark, sf):
    return L.readable(_rows(spark, sf)).select("detection_id")


@query("fl07_plate_history", "select plate_id, plate_number from plates where plate_number <> '' and detection_status = 2 and created_at >= timestamp '2024-01-10'")
def plate_history(spark, sf):
    return T.plates(spark, sf).filter("plate_number <> ''").filter(L.conditions(date(2024, 1, 10), status=2)).select("plate_id", "plate_number")


@query("fl08_search", ROWS + "select detection_id from rows_ where contains(upper(coalesce(plate_number, '')), 'B1') or contains(upper(coalesce(location, '')), 'B1')")
def search(spark, sf):
    return L.search(_rows(spark, sf), "b1", "plate_number", "location").select("detection_id")


@query("fl09_late_details", ROWS + "select detection_id, camera_name from rows_ where detection_id in (select detection_id from detections order by created_at desc, detection_id desc limit 50)")
def late_details(spark, sf):
    ids = T.detections(spark, sf).orderBy(F.desc("created_at"), F.desc("detection_id")).limit(50).select("detection_id")
    return _rows(spark, sf).join(ids, "detection_id", "left_semi").select("detection_id", "camera_name")


@query("fl10_display_names", ROWS + "select camera_name, count(*) as n from rows_ group by 1")
def display_names(spark, sf):
    return _rows(spark, sf).groupBy("camera_name").agg(F.count("*").alias("n"))


@query("fl11_shaped", ROWS + "select detection_id, case when object_type = 'person' then 'person' when has_plate = 1 then 'plate' else 'vehicle' end as type, camera_name, case detection_status when 1 then 'Terbaca' when 2 then 'Perlu cek' else 'Gagal' end as status, round(coalesce(nullif(ocr_confidence, 0), nullif(detection_confidence, 0), 0) * 100, 1) as confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from rows_")
def shaped(spark, sf):
    return L.shaped(_rows(spark, sf)).withColumn("created_at", stamp())


@query("fl12_revalidated", "select plate_id, plate_number as shown, case when ocr_confidence >= 0.7 and plate_crop_quality >= 0.45 then 1 else 2 end as code, plate_number as raw from plates")
def revalidated(spark, sf):
    return L.revalidated(T.plates(spark, sf))


@query("fl13_recent", "select detection_id, camera_id from dedup order by created_at desc, detection_id desc limit 100", events=True)
def recent(spark, sf):
    return events(spark, sf).orderBy(F.desc("created_at"), F.desc("detection_id")).limit(100).select("detection_id", "camera_id")


@query("fl14_latest", "select plate_id, plate_number from plates order by created_at desc, plate_id desc limit 1")
def latest(spark, sf):
    return T.plates(spark, sf).orderBy(F.desc("created_at"), F.desc("plate_id")).limit(1).select("plate_id", "plate_number")


@query("fl15_frequent", "select plate_number, count(*) as n from plates group by 1 having count(*) >= 2")
def frequent(spark, sf):
    return T.plates(spark, sf).groupBy("plate_number").agg(F.count("*").alias("n")).filter("n >= 2")


@query("fl18_camera_summary", "select count(*) as n, count_if(status = 1) as active, count_if(status <> 1) as inactive from cameras where contains(upper(location), 'A')")
def camera_summary(spark, sf):
    c = L.search(T.cameras(spark, sf), "a", "location")
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("status") == 1).alias("active"), F.count_if(F.col("status") != 1).alias("inactive"))


@query("fl19_export_rows", ROWS + "select detection_id, camera_name, case when plate_number <> '' then plate_number else '-' end as plate, round(detection_confidence * 100, 1) as confidence from rows_")
def export_rows(spark, sf):
    plate = F.when(F.col("plate_number") != "", F.col("plate_number")).otherwise("-")
    return _rows(spark, sf).select("detection_id", "camera_name", plate.alias("plate"), X.percent(F.col("detection_confidence")).alias("confidence"))


@query("fl20_camera_labels", "select camera_id, case when status = 1 then 'Aktif' else 'Nonaktif' end as label from cameras")
def camera_labels(spark, sf):
    return T.cameras(spark, sf).select("camera_id", X.camera_status(F.col("status")).alias("label"))


@query("fl21_admitted_vehicles", "select box_id from boxes where kind = 'vehicle' and x2 - x1 >= 100 and y2 - y1 >= 70 and (x2 - x1) / (y2 - y1) between 0.5 and 4 and confidence >= 0.25")
def admitted_vehicles(spark, sf):
    return L.admitted(T.boxes(spark, sf).filter("kind = 'vehicle'"), 100, 70, 0.5, 4.0, 0.25).select("box_id")


@query("fl22_plate_proportion", "select a.box_id as plate_box, b.box_id as vehicle_box from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle' and (a.x2 - a.x1) <= 0.85 * (b.x2 - b.x1) and (a.y2 - a.y1) <= 0.40 * (b.y2 - b.y1) and (a.x2 - a.x1) * (a.y2 - a.y1) <= 0.22 * (b.x2 - b.x1) * (b.y2 - b.y1)")
def plate_proportion(spark, sf):
    b = T.boxes(spark, sf)
    a, v = b.filter("kind = 'plate'").alias("a"), b.filter("kind = 'vehicle'").alias("b")
    fits = "(a.x2 - a.x1) <= 0.85D * (b.x2 - b.x1) and (a.y2 - a.y1) <= 0.40D * (b.y2 - b.y1) and (a.x2 - a.x1) * (a.y2 - a.y1) <= 0.22D * (b.x2 - b.x1) * (b.y2 - b.y1)"
    return a.join(v, "frame").filter(fits).select(F.col("a.box_id").alias("plate_box"), F.col("b.box_id").alias("vehicle_box"))


@query("fl24_ocr_gate", "select box_id from boxes where kind = 'plate' and x2 - x1 >= 30 and y2 - y1 >= 10 and confidence >= 0.22")
def ocr_gate(spark, sf):
    return L.admitted(T.boxes(spark, sf).filter("kind = 'plate'"), 30, 10, 0.0, 1e9, 0.22).select("box_id")


@query("fl25_event_gate", VOTED + "select track_id, text from stable where valid and stable and total >= 2 and confidence >= 0.45")
def event_gate(spark, sf):
    """Votes that may become events: valid, stable, two readings and a confidence of 0.45."""
    from ..operators.votes import votes

    return votes(T.readings(spark, sf)).filter("valid and stable and total >= 2 and confidence >= 0.45").select("track_id", "text")


@query("fl26_person_gate", "select detection_id from detections where object_type = 'person' and detection_confidence >= 0.40 and track_id >= 0")
def person_gate(spark, sf):
    return T.detections(spark, sf).filter("object_type = 'person' and detection_confidence >= 0.40D and track_id >= 0").select("detection_id")


@query("sl01_page_count", "select count(*) as total, cast(greatest(1, ceil(count(*) / 20.0)) as bigint) as total_pages from detections where object_type = 'person'")
def page_count(spark, sf):
    return L.page_count(T.detections(spark, sf).filter("object_type = 'person'"), 20)


@query("sl03_top_cameras", "select camera_id, count(*) as n from detections group by 1 order by n desc, camera_id limit 12")
def top_cameras(spark, sf):
    return T.detections(spark, sf).groupBy("camera_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "camera_id").limit(12)


@query("sl07_round_robin", "select box_id from (select box_id, row_number() over (partition by frame order by box_id) - 1 as r, count(*) over (partition by frame) as n from boxes) where ((r - 2) % n + n) % n < 4")
def round_robin(spark, sf):
    return L.round_robin(T.boxes(spark, sf), 2, 4).select("box_id")


@query("sl08_text_lines", """, l as (select frame, x1, y1, box_id, case when y1 - lag(y1) over w > 12 then 1 else 0 end as below from boxes window w as (partition by frame order by y1, x1)),
m as (select *, sum(below) over (partition by frame order by y1, x1) as line from l)
select frame as group_id, string_agg(cast(box_id as varchar), ' ' order by line, x1, cast(box_id as varchar)) as text from m group by 1""")
def text_lines(spark, sf):
    return L.text_lines(T.boxes(spark, sf).selectExpr("frame as group_id", "x1 as x", "y1 as y", "cast(box_id as string) as text"))


@query("sl09_bounded_history", "select detection_id from (select detection_id, row_number() over (partition by camera_id, track_id order by created_at desc, detection_id desc) rn from detections) where rn <= 5")
def bounded_history(spark, sf):
    return J.newest(T.detections(spark, sf), ["camera_id", "track_id"], 5).select("detection_id")


@query("sc04_work_queue", "select detection_id from detections where object_type = 'vehicle' and has_plate = 0 and detection_id % 2 = 0 and detection_id % 5 < 3 order by created_at desc, detection_id desc limit 10")
def work_queue(spark, sf):
    rows = T.detections(spark, sf).selectExpr("*", "case when detection_id % 2 = 0 then 'x.jpg' end as image", "cast(detection_id % 5 as int) as retries")
    return L.work_queue(rows).select("detection_id")


@query("fl16_recurrence_filter", "select plate_number, count(*) as n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen from plates group by 1 having count(*) >= 2 and max(created_at) >= timestamp '2024-01-15' and contains(plate_number, 'B1')")
def recurrence_filter(spark, sf):
    found = T.plates(spark, sf).groupBy("plate_number").agg(F.count("*").alias("n"), F.max("created_at").alias("created_at"))
    found = L.search(found.filter("n >= 2").filter(L.conditions(date(2024, 1, 15))), "B1", "plate_number")
    return found.select("plate_number", "n", stamp().alias("last_seen"))


@query("fl17_camera_day_search", "select d.camera_id, cast(created_at as date) as day, count(*) as n from detections d join cameras c on d.camera_id = c.camera_id where contains(upper(location), 'MASUK') group by 1, 2")
def camera_day_search(spark, sf):
    rows = T.detections(spark, sf).join(T.cameras(spark, sf).select("camera_id", "location"), "camera_id")
    return L.search(rows, "masuk", "location").groupBy("camera_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


@query("fl23_plate_detector", "select box_id, greatest(x1 - (x2 - x1) * 0.08, 0) as px1, least(x2 + (x2 - x1) * 0.08, 800) as px2 from boxes where kind = 'plate' and x2 - x1 >= 24 and y2 - y1 >= 8 and (x2 - x1) / (y2 - y1) between 1.2 and 8")
def plate_detector(spark, sf):
    from ..functions import geometry as G

    kept = L.admitted(T.boxes(spark, sf).filter("kind = 'plate'"), 24, 8, 1.2, 8.0)
    grown = G.expand(G.box(), 0.08, 800.0, 500.0)
    return kept.select("box_id", grown[0].alias("px1"), grown[2].alias("px2"))
