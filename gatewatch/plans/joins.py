"""Queries over joins, look-backs and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import joins as J
from ..operators.dedup import previous_match
from ..sources import tables as T

BOTH = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
OWN = "((a.x2 - a.x1) * (a.y2 - a.y1))"
OTHER = "((b.x2 - b.x1) * (b.y2 - b.y1))"


#: Pairs `p` of a frame in order (rn), each taken if both of its boxes are free.
GREEDY = """, g as (select frame, rn, a, b, [a] as ua, [b] as ub, true as took from p where rn = 1
union all select frame, rn, a, b, case when ok then list_append(ua, a) else ua end, case when ok then list_append(ub, b) else ub end, ok
from (select p.frame, p.rn, p.a, p.b, g.ua, g.ub, not list_contains(g.ua, p.a) and not list_contains(g.ub, p.b) as ok from g join p on p.frame = g.frame and p.rn = g.rn + 1)) """


def _boxes(spark, sf):
    b = T.boxes(spark, sf)
    return b.filter("kind = 'plate'"), b.filter("kind = 'vehicle'")


@query("jn01_details", "select d.detection_id, p.plate_number, coalesce(d.source_name, c.location, 'CCTV') as camera_name from detections d left join plates p using (plate_id) left join cameras c on d.camera_id = c.camera_id")
def details(spark, sf):
    return J.details(T.detections(spark, sf), T.plates(spark, sf), T.cameras(spark, sf)).select("detection_id", "plate_number", "camera_name")


@query("jn02_read_details", "select d.detection_id, p.plate_number, p.detection_status, c.location from detections d join plates p using (plate_id) left join cameras c on d.camera_id = c.camera_id")
def read_details(spark, sf):
    return J.read_details(T.detections(spark, sf), T.plates(spark, sf), T.cameras(spark, sf)).select("detection_id", "plate_number", "detection_status", "location")


LOGS = ", logs as (select plate_id, (plate_id * 7) % 27 as camera_id from plates where plate_id % 3 <> 0 union all select plate_id, 3 from plates where plate_id % 10 = 1) "


def _logs(spark, sf):
    p = T.plates(spark, sf)
    return p.filter("plate_id % 3 <> 0").selectExpr("plate_id", "(plate_id * 7) % 27 as camera_id").unionAll(p.filter("plate_id % 10 = 1").selectExpr("plate_id", "3L as camera_id"))


@query("jn03_fan_out", LOGS + "select p.plate_id, p.plate_number, coalesce(d.camera_id, l.camera_id) as camera_id, c.location from plates p left join logs l using (plate_id) left join (select * from detections where detection_id % 4 <> 0) d on d.plate_id = p.plate_id left join cameras c on coalesce(d.camera_id, l.camera_id) = c.camera_id")
def fan_out(spark, sf):
    """JN-3 and JN-4: plates fan out over their logs; the camera comes from an expression key."""
    return J.plates_with_logs(T.plates(spark, sf), _logs(spark, sf), T.detections(spark, sf).filter("detection_id % 4 <> 0"), T.cameras(spark, sf))


@query("jn06_semi", "select detection_id from detections where camera_id in (select camera_id from cameras where status = 1)")
def semi(spark, sf):
    return T.detections(spark, sf).join(T.cameras(spark, sf).filter("status = 1"), "camera_id", "left_semi").select("detection_id")


@query("jn07_reconcile", "select distinct camera_id from detections where camera_id not in (select camera_id from cameras where status = 1)")
def reconcile(spark, sf):
    return J.not_active(T.detections(spark, sf).select("camera_id").distinct(), T.cameras(spark, sf).filter("status = 1"))


@query("jn07_changed", "select camera_id, concat(location, ' 2') as location from cameras where camera_id % 4 = 0")
def changed(spark, sf):
    c = T.cameras(spark, sf)
    return J.changed(c, c.withColumn("location", F.when(F.col("camera_id") % 4 == 0, F.concat("location", F.lit(" 2"))).otherwise(F.col("location"))))


@query("jn08_look_back", """select d.detection_id, (select arg_max(o.detection_id, row(o.created_at, o.detection_id)) from detections o where o.camera_id = d.camera_id and o.vehicle_type = d.vehicle_type and epoch(o.created_at)::bigint between epoch(d.created_at)::bigint - 21600 and epoch(d.created_at)::bigint - 1) as prior_id from detections d""".replace("epoch(o.created_at)::bigint", "cast(floor(epoch(o.created_at)) as bigint)").replace("epoch(d.created_at)::bigint", "cast(floor(epoch(d.created_at)) as bigint)"))
def look_back(spark, sf):
    return previous_match(T.detections(spark, sf), ["camera_id", "vehicle_type"], 21_600).select("detection_id", "prior_id")


@query("jn09_track_look_back", "select d.detection_id, (select arg_max(o.detection_id, row(o.created_at, o.detection_id)) from detections o where o.camera_id = d.camera_id and o.track_id = d.track_id and cast(floor(epoch(o.created_at)) as bigint) between cast(floor(epoch(d.created_at)) as bigint) - 86400 and cast(floor(epoch(d.created_at)) as bigint) - 1) as prior_id from detections d")
def track_look_back(spark, sf):
    return previous_match(T.detections(spark, sf), ["camera_id", "track_id"], 86_400).select("detection_id", "prior_id")


HASHES = ", h as (select detection_id as id, camera_id, object_type, created_at, substr(md5(cast(track_id % 7 as varchar)), 1, 14) || substr(md5(cast(detection_id as varchar)), 1, 2) as hash from detections) "


@query("jn10_similar_hashes", HASHES + "select a.id, arg_max(b.id, row(b.created_at, b.id)) as other from h a join h b on a.camera_id = b.camera_id and a.object_type = b.object_type and a.id <> b.id and epoch_us(a.created_at) - epoch_us(b.created_at) between 0 and 1800000000::bigint and bit_count(xor(cast('0x' || a.hash as ubigint), cast('0x' || b.hash as ubigint))::bit) <= 6 group by a.id")
def similar_hashes(spark, sf):
    """The newest similar row: 64-bit hashes of a camera and type within half an hour, at six bits or fewer."""
    h = T.detections(spark, sf).selectExpr("detection_id as id", "camera_id", "object_type", "created_at", "concat(substr(md5(cast(track_id % 7 as string)), 1, 14), substr(md5(cast(detection_id as string)), 1, 2)) as hash")
    return J.similar_hashes(h, h)


@query("jn11_containing_vehicle", "select a.box_id as plate_box, arg_min(b.box_id, row((b.x2 - b.x1) * (b.y2 - b.y1), b.box_id)) as vehicle_box from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle' and (a.x1 + a.x2) / 2 between b.x1 and b.x2 and (a.y1 + a.y2) / 2 between b.y1 and b.y2 group by 1")
def containing_vehicle(spark, sf):
    return J.containing_vehicle(*_boxes(spark, sf))


@query("jn12_overlapping_vehicle", f"select plate_box, arg_max(b, row(share, -b)) as vehicle_box, round(max(share), 6) as share from (select a.box_id as plate_box, b.box_id as b, {BOTH} / {OWN} as share from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle') where share > 0 group by 1")
def overlapping_vehicle(spark, sf):
    return J.overlapping_vehicle(*_boxes(spark, sf))


@query("jn13_resolved_vehicle", f""", t as (select b.*, d.camera_id, d.track_id from boxes b join detections d on d.detection_id = b.box_id),
tr as (select a.box_id as p, min(b.box_id) as v from t a join t b on a.frame = b.frame and a.camera_id % 5 = b.camera_id % 5 and a.track_id % 5 = b.track_id % 5 where a.kind = 'plate' and b.kind = 'vehicle' group by 1),
inn as (select a.box_id as p, arg_min(b.box_id, row((b.x2 - b.x1) * (b.y2 - b.y1), b.box_id)) as v from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle' and (a.x1 + a.x2) / 2 between b.x1 and b.x2 and (a.y1 + a.y2) / 2 between b.y1 and b.y2 group by 1),
cov as (select p, arg_max(v, row(share, -v)) as v from (select a.box_id as p, b.box_id as v, {BOTH} / {OWN} as share from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle') where share > 0 group by 1)
select box_id as plate_box, coalesce(tr.v, inn.v, cov.v) as vehicle_box from boxes left join tr on tr.p = box_id left join inn on inn.p = box_id left join cov on cov.p = box_id where kind = 'plate'""")
def resolved_vehicle(spark, sf):
    """By the track's vehicle where there is one, else by containment, else by overlap."""
    plates, vehicles = _boxes(spark, sf)
    tracked = T.detections(spark, sf).selectExpr("detection_id as box_id", "camera_id % 5 as camera", "track_id % 5 as track")
    by_track = J.same_track(plates.join(tracked, "box_id"), vehicles.join(tracked, "box_id"))
    return J.resolved_vehicle(plates, by_track, J.containing_vehicle(plates, vehicles), J.overlapping_vehicle(plates, vehicles))


#: Two vehicles and a plate of three events, 24 events a frame; a plate is ready unless its reading is poor.
VEHICLE_ROWS = "select id // 24 as frame, camera_id % 2 as camera_id, id, person_group as vehicle_group, case when track >= 0 then track end as track, id % 2 + 1 as generation, x1, y1, x2 + 120 as x2, y2 + 80 as y2 from sightings where id % 3 <> 0"
PLATE_ROWS = "select id // 24 as frame, camera_id % 2 as camera_id, id, vehicle_group, vehicle as track, generation, x1, y1, x2, y2, ocr >= 0.3 as ready, id % 2 = 0 as stable, id % 5 > 0 as valid, 0.45 * ocr + 0.25 * quality as score, confidence from plate_boxes where id % 3 = 0"


def _sql_rows(spark, sf, sql: str, name: str):
    """Rows of one of the two statements above."""
    getattr(T, name)(spark, sf).createOrReplaceTempView(f"gatewatch_{name}")
    return spark.sql(sql.replace("id // 24", "id div 24").replace(f"from {name}", f"from gatewatch_{name}"))


@query("jn13_best_plates", f""", v as ({VEHICLE_ROWS}), p as ({PLATE_ROWS}),
m as (select v.id as vehicle, p.*, case when p.vehicle_group is not null then 'group' when p.track is not null then 'track' else 'place' end as how from v join p on v.camera_id = p.camera_id and v.frame = p.frame and
case when p.vehicle_group is not null then p.vehicle_group = v.vehicle_group and coalesce(p.generation = v.generation, true) when p.track is not null then p.track = v.track and coalesce(p.generation = v.generation, true)
else (p.x1 + p.x2) / 2 between v.x1 and v.x2 and (p.y1 + p.y2) / 2 between v.y1 and v.y2 end),
k as (select *, bool_or(how <> 'place') over (partition by vehicle) as known from m),
r as (select *, row_number() over (partition by vehicle order by stable desc, valid desc, score desc, confidence desc, id) as rn from k where ready and (how <> 'place') = known)
select vehicle, id as plate, how from r where rn = 1""")
def best_plates(spark, sf):
    """JN-13 by group, track with generation, and place."""
    return J.best_plates(_sql_rows(spark, sf, VEHICLE_ROWS, "sightings"), _sql_rows(spark, sf, PLATE_ROWS, "plate_boxes"))


@query("jn13_vehicle_of_plate", f""", v as ({VEHICLE_ROWS}), p as ({PLATE_ROWS}),
m as (select p.id as plate, v.id as vehicle, (v.x2 - v.x1) * (v.y2 - v.y1) as size, coalesce(p.generation = v.generation, true) as agree, p.vehicle_group = v.vehicle_group as g, p.track = v.track as t, (p.x1 + p.x2) / 2 between v.x1 and v.x2 and (p.y1 + p.y2) / 2 between v.y1 and v.y2 as inside from p join v on p.camera_id = v.camera_id and p.frame = v.frame),
k as (select plate, vehicle, 'group' as how, 0 as tier, 0 as size from m where g and agree union all select plate, vehicle, 'track', 1, 0 from m where t and agree union all select plate, vehicle, 'place', 2, size from m where inside)
select plate, vehicle, how from k qualify row_number() over (partition by plate order by tier, size, vehicle) = 1""")
def vehicle_of_plate(spark, sf):
    """JN-13 from the plate's side, as SK-21 needs it."""
    return J.vehicle_of_plate(*(_sql_rows(spark, sf, sql, name) for sql, name in ((PLATE_ROWS, "plate_boxes"), (VEHICLE_ROWS, "sightings"))))


@query("jn14_drivers", f""", p as (select a.frame, a.box_id as a, b.box_id as b, row_number() over (partition by a.frame order by a.box_id, b.box_id) as rn from boxes a join boxes b using (frame)
where a.kind = 'plate' and b.kind = 'vehicle' and ({BOTH} / {OWN} >= 0.20 or (a.x1 + a.x2) / 2 between b.x1 and b.x2 and (a.y1 + a.y2) / 2 between b.y1 and b.y2)){GREEDY} select a as person, b as vehicle from g where took""")
def drivers(spark, sf):
    return J.drivers(*_boxes(spark, sf))


@query("jn15_suppressed", f"select box_id from boxes where kind = 'plate' and box_id not in (select a.box_id from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle' and {BOTH} / {OWN} >= 0.25)")
def suppressed(spark, sf):
    return J.not_overlapping(*_boxes(spark, sf)).select("box_id")


def _tracks(spark, sf):
    v = T.boxes(spark, sf).filter("kind = 'vehicle'")
    return v.filter("box_id % 2 = 0"), v.filter("box_id % 2 = 1")


@query("jn16_greedy_matches", f""", q as (select a.frame, a.box_id as a, b.box_id as b, {BOTH} / ({OWN} + (b.x2 - b.x1) * (b.y2 - b.y1) - {BOTH}) as iou from boxes a join boxes b using (frame) where a.kind = 'vehicle' and b.kind = 'vehicle' and a.box_id % 2 = 0 and b.box_id % 2 = 1),
p as (select *, row_number() over (partition by frame order by iou desc, a, b) as rn from q where iou >= 0.35){GREEDY} select frame, a as detection, b as track from g where took""")
def greedy_matches(spark, sf):
    return J.greedy_matches(*_tracks(spark, sf))


@query("jn17_capture_lookup", "select id, coalesce((select arg_max(c.detection_id, row(c.created_at, c.detection_id)) from detections c where c.has_plate = 1 and c.event_key = w.event_key), (select arg_max(c.detection_id, row(c.created_at, c.detection_id)) from detections c where c.has_plate = 1 and c.track_id = w.track_id)) as capture_id from (select detection_id as id, event_key, track_id from detections where has_plate = 0) w where capture_id is not null")
def capture_lookup(spark, sf):
    d = T.detections(spark, sf)
    wanted = d.filter("has_plate = 0").selectExpr("detection_id as id", "event_key", "track_id")
    return J.capture_lookup(wanted, d.filter("has_plate = 1").withColumnRenamed("detection_id", "capture_id"), ["event_key", "track_id"])


@query("jn18_camera_names", "select d.detection_id, c.location from detections d left join cameras c using (camera_id)")
def camera_names(spark, sf):
    return T.detections(spark, sf).join(T.cameras(spark, sf).select("camera_id", "location"), "camera_id", "left").select("detection_id", "location")


@query("jn19_not_tracked", f"select box_id from boxes where kind = 'vehicle' and box_id % 2 = 1 union all select box_id from boxes where kind = 'vehicle' and box_id % 2 = 0 and box_id not in (select a.box_id from boxes a join boxes b using (frame) where a.kind = 'vehicle' and b.kind = 'vehicle' and a.box_id % 2 = 0 and b.box_id % 2 = 1 and {BOTH} / ({OWN} + {OTHER} - {BOTH}) >= 0.30)")
def not_tracked(spark, sf):
    return J.not_tracked(*_tracks(spark, sf)).select("box_id")


@query("jn20_camera_settings", "select camera_id, case when camera_id % 5 = 0 then 'run' when camera_id % 2 = 0 then 'config' else 'default' end as value from cameras")
def camera_settings(spark, sf):
    c = T.cameras(spark, sf)
    return J.camera_settings(c, c.filter("camera_id % 2 = 0").selectExpr("camera_id", "'config' as value"), c.filter("camera_id % 5 = 0").selectExpr("camera_id", "'run' as value"), "default")


@query("sl06_suppressed_centres", """, c as (select frame, box_id, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, row_number() over (partition by frame order by confidence desc, box_id) as rn from boxes where kind = 'plate'),
k as (select frame, rn, box_id, [{'x': x, 'y': y}] as kept, true as took from c where rn = 1
union all select frame, rn, box_id, case when ok then list_append(kept, {'x': x, 'y': y}) else kept end, ok
from (select c.*, k.kept, len(list_filter(k.kept, lambda o: sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)) < 18)) = 0 as ok from k join c on c.frame = k.frame and c.rn = k.rn + 1))
select box_id from k where took""")
def suppressed_centres(spark, sf):
    return J.suppressed(T.boxes(spark, sf).filter("kind = 'plate'"))
