"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import analytics as A
from ..operators import votes
from ..sources import tables as T
from .scalars import VOTED
from .shared import events, events_with_plates, stamp

COUNTS = """count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'vehicle' and direction = 'entry') as vehicle_entry, count_if(object_type = 'vehicle' and direction = 'exit') as vehicle_exit,
count_if(object_type = 'person') as people, count_if(object_type = 'person' and direction = 'entry') as person_entry, count_if(object_type = 'person' and direction = 'exit') as person_exit,
count_if(has_plate = 1) as plates, count(distinct case when plate_number <> '' then plate_number end) as unique_plates"""
HOURS = """, h as (select r.hour, coalesce(e.vehicles, 0) as vehicles, coalesce(e.people, 0) as people from (select unnest(range(24)) as hour) r
left join (select hour(created_at) as hour, count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'person') as people from ev group by 1) e using (hour))
"""


@query("ag01_summary", f"select {COUNTS} from ev", events=True)
def summary(spark, sf):
    return A.summary(events_with_plates(spark, sf))


@query("ag02_unique_plates", "select direction, count(distinct case when has_plate = 1 then plate_number end) as unique_plates from ev group by 1", events=True)
def unique_plates(spark, sf):
    return events_with_plates(spark, sf).groupBy("direction").agg(F.count_distinct(F.when(F.col("has_plate") == 1, F.col("plate_number"))).alias("unique_plates"))


@query("ag03_camera_totals", "select count(*) as cameras, count_if(status = 1) as active from cameras")
def camera_totals(spark, sf):
    return A.camera_totals(T.cameras(spark, sf))


@query(
    "ag04_per_camera",
    """select camera_id, coalesce(max(source_name), max(location), concat('CCTV-', camera_id)) as camera, max(c.direction) as camera_direction, case when max(c.status) = 1 then 'Aktif' else 'Nonaktif' end as camera_status,
count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'person') as people, count_if(has_plate = 1) as plates from ev left join cameras c using (camera_id) group by camera_id""",
    events=True,
)
def per_camera(spark, sf):
    return A.per_camera(events_with_plates(spark, sf), T.cameras(spark, sf))


@query("ag05_daily", f"select cast(created_at as date) as day, {COUNTS} from ev group by 1", events=True)
def daily(spark, sf):
    return A.daily(events_with_plates(spark, sf))


@query("ag06_hourly", HOURS + "select cast(hour as int) as hour, concat(lpad(cast(hour as varchar), 2, '0'), ':00') as label, vehicles, people from h", events=True)
def hourly(spark, sf):
    return A.hourly(events(spark, sf))


@query("ag07_vehicle_types", "select count_if(vehicle_type = 'car') as car, count_if(vehicle_type = 'motorcycle') as motorcycle, count_if(vehicle_type = 'truck') as truck, count_if(vehicle_type = 'bus') as bus, count_if(vehicle_type is null or vehicle_type not in ('car', 'motorcycle', 'truck', 'bus')) as other from ev where object_type = 'vehicle'", events=True)
def vehicle_types(spark, sf):
    return A.vehicle_types(events(spark, sf))


@query("ag08_plate_performance", "select count(*) as total, count_if(plate_status = 1) as valid, count_if(plate_status = 2) as to_check, count_if(plate_status = 0) as failed, round(avg(case when plate_status in (1, 2) then ocr_confidence end) * 100, 1) as mean_confidence, round(count_if(plate_status = 1) * 100.0 / nullif(count(*), 0), 1) as read_rate from ev where plate_status is not null", events=True)
def plate_performance(spark, sf):
    return A.plate_performance(events_with_plates(spark, sf)).withColumn("read_rate", F.col("read_rate").cast("double"))


@query("ag09_top_plates", "select plate_number, count(*) as times, round(avg(ocr_confidence), 6) as mean_confidence, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen, max(plate_status) as best_status from ev where plate_number <> '' group by 1 order by times desc, max(created_at) desc, plate_number limit 10", events=True)
def top_plates(spark, sf):
    return A.top_plates(events_with_plates(spark, sf)).withColumn("last_seen", stamp("last_seen"))


@query("ag10_peak_hour", HOURS + "select label, vehicles, concat('Jam tersibuk ', label, ' dengan ', replace(format('{:,}', vehicles), ',', '.'), ' kendaraan') as insight from (select concat(lpad(cast(hour as varchar), 2, '0'), ':00') as label, vehicles, hour from h order by vehicles desc, hour limit 1)", events=True)
def peak_hour(spark, sf):
    return A.peak_hour(A.hourly(events(spark, sf)))


@query("ag11_camera_share", "select camera_id, count(*) as vehicles, round(count(*) * 100.0 / sum(count(*)) over (), 1) as share from ev where object_type = 'vehicle' group by 1", events=True)
def camera_share(spark, sf):
    return A.camera_share(events(spark, sf)).withColumn("share", F.col("share").cast("double"))


@query("ag11_trend", "select d.day, strftime(d.day, '%d/%m') as label, coalesce(v, 0) as vehicles, coalesce(p, 0) as people from (select cast(date '2024-01-01' + cast(i as int) as date) as day from (select unnest(range(30)) as i)) d left join (select cast(created_at as date) as day, count_if(object_type = 'vehicle') as v, count_if(object_type = 'person') as p from ev group by 1) e on d.day = e.day", events=True)
def trend(spark, sf):
    return A.trend(events(spark, sf), "2024-01-01", 30)


@query("ag11_busiest_hours", HOURS + "select cast(hour as int) as hour, vehicles, round(vehicles * 100.0 / nullif(sum(vehicles) over (), 0), 1) as share from h order by vehicles desc, hour limit 3", events=True)
def busiest_hours(spark, sf):
    return A.busiest_hours(A.hourly(events(spark, sf))).withColumn("share", F.col("share").cast("double"))


STATISTICS = """, w as (select * from ev where {where}), n as (select greatest(count(*), 1) as n from w), pl as (select * from plates),
x as (select w.*, coalesce(w.source_name, c.location, 'CCTV') as camera, coalesce(c.location, 'CCTV') as place_name from w left join cameras c using (camera_id)),
t as (select {slot} as slot, count(*) as total, count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'vehicle' and has_plate = 1) as plates, count_if(object_type = 'person') as faces from w group by 1)
select 'kpi' as section, 1::int as place, 'all' as label, count(*) as total, count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'vehicle' and has_plate = 1) as plates, count_if(object_type = 'person') as faces,
coalesce(round(count_if(object_type = 'vehicle' and has_plate = 1) * 100.0::double / nullif(count_if(object_type = 'vehicle'), 0), 1), 0) as percent, round(cast(coalesce(avg(detection_confidence), 0.85) as decimal(20,10)) * 100, 1)::double as confidence, null::varchar as last_seen, null::varchar as status from w
union all select 'status', v.i::int, v.l, (select count(*) from w where detection_status = v.s), null, null, null, null, null, null, null from (values (1, 'valid', 1), (2, 'warning', 2), (3, 'failed', 0)) v(i, l, s)
union all select 'availability', 1, 'active', count_if(status = 1), null, null, null, coalesce(round(count_if(status = 1) * 100.0::double / nullif(count(*), 0), 1), 0), null, null, null from cameras
union all {trend}
union all select 'camera', cast(row_number() over (order by count(*) desc, camera_id, camera) as int), camera, count(*), count_if(object_type = 'vehicle'), count_if(object_type = 'vehicle' and has_plate = 1), count_if(object_type = 'person'), round(count(*) * 100.0::double / (select n from n), 1), null, null, null from x group by camera_id, camera
union all select 'peak', cast(rn as int), lpad(cast(h as varchar), 2, '0') || ':00 - ' || lpad(cast(h + 1 as varchar), 2, '0') || ':00 WIB', c, null, null, null, round(c * 100.0::double / (select n from n), 1), null, null, null from (select hour(created_at) as h, count(*) as c, row_number() over (order by count(*) desc, hour(created_at)) as rn from w group by 1) where rn <= 3
union all select 'plate', cast(rn as int), plate_number, c, null, null, null, null, round(cast(coalesce(r, 0.8) as decimal(20,10)) * 100, 1)::double, l, case b when 1 then 'Terbaca' when 2 then 'Perlu cek' else 'Gagal' end from (select plate_number, count(*) as c, avg(ocr_confidence) as r, strftime(max(created_at), '%Y-%m-%d %H:%M') || ' @ ' || max(place_name) as l, max(plate_status) as b,
row_number() over (order by count(*) desc, max(created_at) desc, plate_number) as rn from x where plate_number <> '' group by 1) where rn <= 10"""
STATISTICS_ALL = STATISTICS.format(where="true", slot="cast(created_at as date)", trend="select 'trend', cast(row_number() over (order by slot) as int), strftime(slot, '%d/%m'), total, vehicles, plates, faces, null, null, null, null from t qualify row_number() over (order by slot) <= 30")
DENSE = "select 'trend', cast(g.i + 1 as int), {label}, coalesce(total, 0), coalesce(vehicles, 0), coalesce(plates, 0), coalesce(faces, 0), null, null, null, null from (select unnest(range({n})) as i) g left join t on t.slot = {slot}"
STATISTICS_WEEK = STATISTICS.format(where="created_at >= date '2024-01-24'", slot="cast(created_at as date)", trend=DENSE.format(n=7, label="strftime(date '2024-01-24' + cast(g.i as int), '%d/%m')", slot="date '2024-01-24' + cast(g.i as int)"))
STATISTICS_DAY = STATISTICS.format(where="created_at >= date '2024-01-30'", slot="hour(created_at)", trend=DENSE.format(n=24, label="lpad(cast(g.i as varchar), 2, '0') || ':00'", slot="g.i"))


@query("ag11_statistics", STATISTICS_ALL, events=True)
def statistics_all(spark, sf):
    """The statistics page of all time, by grouping sets."""
    return A.statistics(events_with_plates(spark, sf), T.cameras(spark, sf))


@query("ag11_statistics_week", STATISTICS_WEEK, events=True)
def statistics_week(spark, sf):
    return A.statistics(events_with_plates(spark, sf), T.cameras(spark, sf), "7d", "2024-01-30")


@query("ag11_statistics_day", STATISTICS_DAY, events=True)
def statistics_day(spark, sf):
    return A.statistics(events_with_plates(spark, sf), T.cameras(spark, sf), "today", "2024-01-30")


@query("ag14_dashboard", "select count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'person') as people, count_if(has_plate = 1) as plates from ev", events=True)
def dashboard(spark, sf):
    return A.summary(events_with_plates(spark, sf)).select("vehicles", "people", "plates")


@query("ag15_availability", "select count(*) as cameras, count_if(status = 1) as active, round(count_if(status = 1) * 100.0 / nullif(count(*), 0), 1) as availability from cameras")
def availability(spark, sf):
    return A.availability(T.cameras(spark, sf)).withColumn("availability", F.col("availability").cast("double"))


@query("ag16_repeated_keys", "select event_key, count(*) as rows from detections where event_key is not null group by 1 having count(*) > 1")
def repeated_keys(spark, sf):
    return A.repeated_keys(T.detections(spark, sf))


@query("ag17_daily_recap", "select strftime(cast(created_at as date), '%d/%m/%Y') as tanggal, count_if(object_type = 'vehicle') as kendaraan, count_if(object_type = 'person') as orang, count(*) as total from ev group by cast(created_at as date)", events=True)
def daily_recap(spark, sf):
    d = A.daily(events_with_plates(spark, sf))
    return d.select(F.date_format("day", "dd/MM/yyyy").alias("tanggal"), F.col("vehicles").alias("kendaraan"), F.col("people").alias("orang"), (F.col("vehicles") + F.col("people")).alias("total"))


@query("ag18_direction_share", "select entry, exit, round(entry * 100.0 / nullif(entry + exit, 0), 1) as entry_share, round(exit * 100.0 / nullif(entry + exit, 0), 1) as exit_share from (select count_if(direction = 'entry') as entry, count_if(direction = 'exit') as exit from ev where object_type = 'vehicle')", events=True)
def direction_share(spark, sf):
    d = A.direction_share(events(spark, sf))
    return d.withColumns({c: F.col(c).cast("double") for c in ("entry_share", "exit_share")})


@query("ag_tumbling_6h", "select strftime(time_bucket(interval 6 hours, created_at, timestamp '2000-01-01'), '%Y-%m-%d %H:%M:%S') as start, count_if(object_type = 'vehicle') as vehicles, count_if(object_type = 'person') as people from ev group by time_bucket(interval 6 hours, created_at, timestamp '2000-01-01')", events=True)
def tumbling(spark, sf):
    return A.windowed(events(spark, sf), "6 hours").withColumn("start", stamp("start"))


@query("ag_running_totals", "select day, vehicles, cast(sum(vehicles) over (order by day) as bigint) as vehicles_so_far from (select cast(created_at as date) as day, count_if(object_type = 'vehicle') as vehicles from ev group by 1)", events=True)
def running(spark, sf):
    return A.running_totals(A.daily(events_with_plates(spark, sf)))


VALID_TEXT = "regexp_full_match(vote, '(A|AA|AB|AD|AE|AG|B|BA|BB|BD|BE|BG|BH|BK|BL|BM|BN|BP|BR|BT|CC|CD|D|DA|DB|DC|DD|DE|DG|DH|DK|DL|DM|DN|DP|DR|DT|DW|E|EA|EB|ED|F|G|H|K|KB|KH|KT|KU|L|M|N|P|PA|PB|PD|PS|PT|PY|R|RI|S|T|W|Z)[0-9]{1,4}[A-Z]{0,3}')"


@query(
    "ud01_plate_votes",
    f""", r as (select plate_id % 500 as track_id, plate_id as reading_id, plate_number as text, ocr_confidence as confidence, greatest(0.05, ocr_confidence) * (0.5 + 0.5 * plate_crop_quality) as w, length(plate_number) as n from plates),
ch as (select track_id, n, i as pos, substr(text, cast(i as int), 1) as c, sum(w) as cw, max(confidence) as cc, min(reading_id) as f from (select *, unnest(range(1, n + 1)) as i from r) group by all),
win as (select track_id, n, pos, arg_max(c, row(round(cw, 12), cc, -f)) as c, max(round(cw, 12)) as won, sum(cw) as tot from ch group by all),
made as (select track_id, n, string_agg(c, '' order by pos) as vote, avg(won / tot) as consensus, max(tot) as gw from win group by all),
pick as (select * from (select *, {VALID_TEXT} as valid, row_number() over (partition by track_id order by round(gw * case when {VALID_TEXT} then 1.08 else 1.0 end, 12) desc, {VALID_TEXT} desc, n) as rn from made) where rn = 1)
select p.track_id, p.vote as text, p.valid, round(p.consensus, 6) as consensus, (select count(*) from r where r.track_id = p.track_id) as total, (select count(*) from r where r.track_id = p.track_id and r.n = p.n) as reads, (select count(*) from r where r.track_id = p.track_id and r.text = p.vote) as exact from pick p""",
)
def plate_votes(spark, sf):
    readings = T.plates(spark, sf).selectExpr("plate_id % 500 as track_id", "plate_id as reading_id", "plate_number as text", "ocr_confidence as confidence", "plate_crop_quality as crop_quality")
    return votes.votes(readings).select("track_id", "text", "valid", F.round("consensus", 6).alias("consensus"), "total", "reads", "exact")


@query("ag20_stable_votes", VOTED + "select track_id, text, round(confidence, 6) as confidence, total >= 2 and stable as stable from stable")
def stable_votes(spark, sf):
    """Votes over noisy readings; a single reading is never stable."""
    v = votes.votes(T.readings(spark, sf))
    return v.select("track_id", "text", F.round("confidence", 6).alias("confidence"), F.when(F.col("total") < 2, False).otherwise(F.col("stable")).alias("stable"))


@query("ag21_best_variant", "select track_id, arg_max(text, row(sc, -reading_id)) as text, arg_max(reading_id, row(sc, -reading_id)) as variant, round(max(sc), 6) as score from (select *, least(0.99::double, confidence + 0.03::double * (count(*) over (partition by track_id, text) - 1)) as sc from readings) group by 1")
def best_variant(spark, sf):
    candidates = T.readings(spark, sf).selectExpr("track_id", "reading_id as variant", "text", "confidence")
    return votes.best_variant(candidates, "track_id")


@query("ag22_pipeline_metrics", "select camera_id, count(*) as frames, round(avg(detection_confidence), 6) as mean_confidence, arg_max(detection_id, row(created_at, detection_id)) as last_detection from detections group by 1")
def pipeline_metrics(spark, sf):
    d = T.detections(spark, sf)
    return d.groupBy("camera_id").agg(F.count("*").alias("frames"), F.round(F.avg("detection_confidence"), 6).alias("mean_confidence"), F.max_by("detection_id", F.struct("created_at", "detection_id")).alias("last_detection"))


@query("sf36_fragments")
def fragments(spark, sf):
    """Fragments of a frame put together: region, number and series stand beside each other, a tax date below."""
    r = T.plates(spark, sf).selectExpr("plate_id as group_id", "regexp_extract(plate_number, '^[A-Z]+', 0) as p", "regexp_extract(plate_number, '[0-9]+', 0) as n", "ocr_confidence as confidence")
    parts = F.array(*[F.struct(t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, x, y in ((F.col("n"), 30.0, 1.0), (F.col("p"), 0.0, 0.0), (F.lit("CD"), 60.0, 2.0), (F.lit("08.28"), 10.0, 40.0))])
    items = r.select("group_id", "confidence", F.explode(parts).alias("i")).select("group_id", "confidence", "i.*")
    return votes.merged_fragments(items)


@query("sf36_boxes")
def merged_boxes(spark, sf):
    """Pieces of text with their boxes, eight readings a group, put together to plates."""
    r = T.readings(spark, sf).selectExpr("cast(floor(reading_id / 8) as bigint) as group_id", "reading_id as place", "case reading_id % 4 when 0 then '08.28' when 1 then regexp_extract(text, '^[A-Za-z]+', 0) when 2 then regexp_extract(text, '[0-9]+', 0) else text end as text", "confidence")
    box = ["cast(place % 4 * 40 as double) as x1", "cast(place % 3 * 30 as double) as y1", "cast(place % 4 * 40 + 35 as double) as x2", "cast(place % 3 * 30 + 12 + place % 5 * 3 as double) as y2"]
    return votes.merged_boxes(r.selectExpr("*", *box)).withColumn("confidence", F.round("confidence", 9))
