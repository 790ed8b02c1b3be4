"""Queries over stateful folds (batch twins) and streams run over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import merge
from ..sources import tables as T
from ..streaming import folds, identities, jobs, persons, requeue, schedule, streams
from ..streaming import plate_tracks as PT
from ..streaming import trackers as K
from .lineage import shared_folder
from .shared import stamp

AT = "cast(unix_micros(created_at) as double) / 1000000D as at"
#: What the steps of SS-10, SS-1 and SS-12 read of a row.
PERSON = ["camera_id", "track_id as track", "detection_id as id", AT, "(x1 + x2) / 2 as x", "(y1 + y2) / 2 as y", "(x2 - x1) * (y2 - y1) as area"]
TRACKED_BOX = ["camera_id", "track_id as track", "box_id as id", AT, "frame", "kind", "x1", "y1", "x2", "y2"]
EVENT_READING = [
    "concat('vehicle:', track_id) as event_key", "reading_id as seq", "text as plate", "confidence as ocr", "confidence as consensus", "crop_quality as quality", "reading_id % 2 = 0 as stable",
    "confidence as vehicle_confidence", "false as has_driver", "'unknown' as direction", "'car' as vehicle_type", "cast(null as string) as image",
]


COOLDOWN = """, r as (select camera_id, track_id, detection_id as id, epoch_us(created_at) as t, row_number() over (partition by camera_id, track_id order by created_at, detection_id) as rn from detections),
k as (select camera_id, track_id, rn, id, t as kept, true as took from r where rn = 1
union all select r.camera_id, r.track_id, r.rn, r.id, case when r.t - k.kept > 43200000000 then r.t else k.kept end, r.t - k.kept > 43200000000 from k join r on r.camera_id = k.camera_id and r.track_id = k.track_id and r.rn = k.rn + 1)
select id from k where took"""
FOCUS = """, r as (select camera_id, detection_id as id, epoch_us(created_at) as t, detection_confidence as score, row_number() over (partition by camera_id order by created_at, detection_id) as rn from detections),
k as (select camera_id, rn, id, id as focus, t, score from r where rn = 1
union all select camera_id, rn, id, case when fresh then id else focus end, case when fresh then now_t else t end, case when fresh then now_score else score end
from (select r.camera_id, r.rn, r.id, k.focus, k.t, k.score, r.t as now_t, r.score as now_score, r.t - k.t > 43200000000 or r.score > k.score + 0.1::double as fresh from k join r on r.camera_id = k.camera_id and r.rn = k.rn + 1))
select id, focus from k"""


GENERATIONS = "select detection_id as id, cast(sum(fresh) over (partition by camera_id, track_id order by created_at, detection_id) as bigint) as generation from (select *, case when epoch_us(created_at) - epoch_us(lag(created_at) over (partition by camera_id, track_id order by created_at, detection_id)) > 86400000000 then 1 else 0 end as fresh from detections)"


@query("ss03_generations", GENERATIONS)
def generations(spark, sf):
    rows = T.detections(spark, sf).selectExpr("camera_id", "track_id", "detection_id as id", AT)
    return folds.fold_batch(rows, ["camera_id", "track_id"], ["at", "id"], K.generation(86_400), "id long, generation long")


@query("ss04_crossings", """, x as (select detection_id, camera_id, track_id, created_at, cast(detection_id % 3 as int) - 1 as side, case when camera_id % 2 = 0 then 'entry' else 'exit' end as way from detections),
y as (select *, last_value(case when side <> 0 then side end ignore nulls) over (partition by camera_id, track_id order by created_at, detection_id rows between unbounded preceding and 1 preceding) as before from x)
select detection_id as id, case when side <> 0 and before <> 0 and side <> before then case when before = 1 then way when way = 'entry' then 'exit' else 'entry' end else 'unknown' end as direction from y""")
def crossings(spark, sf):
    rows = T.detections(spark, sf).selectExpr("camera_id", "track_id", "detection_id as id", AT, "cast(detection_id % 3 as int) - 1 as side", "case when camera_id % 2 = 0 then 'entry' else 'exit' end as camera_direction", "1 as outside")
    return folds.fold_batch(rows, ["camera_id", "track_id"], ["at", "id"], K.crossing(), "id long, direction string")


@query("ss05_plate_tracks", """, a as (select *, epoch_us(created_at) as t, case when epoch_us(created_at) - lag(epoch_us(created_at)) over w > 86400000000 then 1 else 0 end as fresh from readings window w as (partition by track_id order by created_at, reading_id)),
b as (select *, sum(fresh) over (partition by track_id order by created_at, reading_id) as passage from a),
c as (select *, row_number() over (partition by track_id, passage order by created_at, reading_id) as rn from b)
select track_id as track, min(t) / 1000000::double as first_at, max(t) / 1000000::double as last_at, count(*) filter (where rn <= 5) as readings, arg_max(text, row(crop_quality, rn)) filter (where rn <= 5) as best,
max(crop_quality) filter (where rn <= 5) as best_quality, round(avg(confidence) filter (where rn <= 5), 6) as confidence from c group by track_id, passage""")
def plate_tracks(spark, sf):
    rows = T.readings(spark, sf).selectExpr("track_id as track", "text", "confidence", "crop_quality as quality", AT, "reading_id as id")
    step, final = K.plate_track(86_400)
    return folds.fold_batch(rows, ["track"], ["at", "id"], step, "track long, first_at double, last_at double, readings long, best string, best_quality double, confidence double", final)


@query("ss09_cooldown", COOLDOWN)
def cooldown(spark, sf):
    rows = T.detections(spark, sf).selectExpr("camera_id", "track_id", "detection_id as id", AT)
    return folds.fold_batch(rows, ["camera_id", "track_id"], ["at", "id"], K.cooldown(43_200), "id long")


@query("ss10_person_filter")
def person_filter(spark, sf):
    rows = T.detections(spark, sf).join(T.boxes(spark, sf).withColumnRenamed("box_id", "detection_id"), "detection_id").filter("object_type = 'person'")
    return folds.fold_batch(rows.selectExpr(*PERSON), ["camera_id"], ["at", "id"], K.person_filter(track=86_400, near=43_200), "id long, reason string")


@query("ss12_improvements")
def improvements(spark, sf):
    rows = T.readings(spark, sf).selectExpr(*EVENT_READING, AT)
    return folds.fold_batch(merge.prepared(rows, "at"), ["event_key"], ["at", "seq"], K.improvement(), "event_key string, seq long, plate string, status int")


@query("ss01_grouping")
def grouping(spark, sf):
    rows = T.boxes(spark, sf).join(T.detections(spark, sf).selectExpr("detection_id as box_id", "camera_id", "track_id", "created_at"), "box_id")
    rows = rows.selectExpr(*TRACKED_BOX)
    return folds.fold_batch(rows, ["camera_id"], ["at", "id"], K.grouping(gap=86_400, expiry=172_800), "id long, object long, switched boolean")


@query("ss18_focus", FOCUS)
def focus(spark, sf):
    rows = T.detections(spark, sf).selectExpr("camera_id", "detection_id as id", AT, "detection_confidence as score")
    return folds.fold_batch(rows, ["camera_id"], ["at", "id"], K.target_hold(43_200, 0.1), "id long, focus long")


@query("ss14_newest_of_camera", "select camera_id, arg_max(detection_id, row(created_at, detection_id)) as detection_id from detections group by 1")
def newest_of_camera(spark, sf):
    return streams.newest_of_camera(T.detections(spark, sf)).select("camera_id", "detection_id")


@query("ss17_every_third", "select detection_id from detections where detection_id % 3 = 1")
def every_third(spark, sf):
    return folds.run_available(streams.every_nth_frame(streams.detections(spark, sf)).select("detection_id"), "sampled")


@query("ss_stream_counts")
def stream_counts(spark, sf):
    """Windowed counts of the stream: windows that the watermark has passed."""
    return folds.run_available(streams.counts(streams.detections(spark, sf)), "counts").withColumn("start", stamp("start"))


@query("ss09_first_of_key")
def first_of_key(spark, sf):
    rows = streams.first_of_key(streams.detections(spark, sf), ["camera_id", "track_id"]).select("detection_id", "camera_id", "track_id")
    return folds.run_available(rows, "first")


@query("ss11_late_plates")
def late_plates(spark, sf):
    d = streams.detections(spark, sf)
    return folds.run_available(streams.late_plates(d.filter("object_type = 'vehicle'"), d.filter("plate_id is not null"), 43_200), "late")


@query("ss09_stream_cooldown", COOLDOWN)
def stream_cooldown(spark, sf):
    rows = streams.detections(spark, sf).selectExpr("camera_id", "track_id", "detection_id as id", AT, "created_at")
    return folds.run_available(folds.fold_stream(rows, ["camera_id", "track_id"], ["at", "id"], K.cooldown(43_200), "id long", 43_200_000), "cooldown")


@query("ss18_stream_focus", FOCUS)
def stream_focus(spark, sf):
    rows = streams.detections(spark, sf).selectExpr("camera_id", "detection_id as id", AT, "created_at", "detection_confidence as score")
    return folds.run_available(folds.fold_stream(rows, ["camera_id"], ["at", "id"], K.target_hold(43_200, 0.1), "id long, focus long", 43_200_000), "focus")


@query("ss01_stream_grouping")
def stream_grouping(spark, sf):
    rows = streams.boxed(spark, sf).selectExpr(*TRACKED_BOX, "created_at")
    return folds.run_available(folds.fold_stream(rows, ["camera_id"], ["at", "id"], K.grouping(gap=86_400, expiry=172_800), "id long, object long, switched boolean", 172_800_000), "grouping")


@query("ss10_stream_people")
def stream_people(spark, sf):
    rows = streams.boxed(spark, sf).filter("object_type = 'person'").selectExpr(*PERSON, "created_at")
    return folds.run_available(folds.fold_stream(rows, ["camera_id"], ["at", "id"], K.person_filter(track=86_400, near=43_200), "id long, reason string", 86_400_000), "people")


@query("ss12_stream_improvements")
def stream_improvements(spark, sf):
    """Events of the stream, given out again when a reading improves them; readings of an event come in order of time."""
    rows = streams.readings(spark, sf).selectExpr(*EVENT_READING, AT, "created_at")
    rows = merge.prepared(rows, "at", "created_at")
    out = folds.fold_stream(rows, ["event_key"], ["at", "seq"], K.improvement(), "event_key string, seq long, plate string, status int", 30 * 86_400_000)
    return folds.run_available(out, "improvements")


@query("ss03_stream_generations", GENERATIONS)
def stream_generations(spark, sf):
    """As ss03_generations, but a track without rows for two days starts again at 0 once a later micro-batch has let its state go."""
    rows = streams.detections(spark, sf).selectExpr("camera_id", "track_id", "detection_id as id", AT, "created_at")
    out = folds.fold_stream(rows, ["camera_id", "track_id"], ["at", "id"], K.generation(86_400), "id long, generation long", 172_800_000)
    return folds.run_available(out, "generations")


@query("ss22_session_windows", """select camera_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select *, sum(f) over (partition by camera_id order by created_at) as s from (select *, case when epoch_us(created_at) - epoch_us(lag(created_at) over (partition by camera_id order by created_at)) > 3600000000 then 1 else 0 end as f from detections)) group by camera_id, s""")
def session_windows(spark, sf):
    """Natural extension of WN-4: sessions of a camera with a gap of an hour."""
    found = T.detections(spark, sf).groupBy("camera_id", F.session_window("created_at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.min("created_at").alias("start"))
    return found.select("camera_id", stamp("start"), "n")


@query("ss05_tracked_plates")
def tracked_plates(spark, sf):
    """SS-5 to SS-8: plates of each camera followed, read, voted on and given out."""
    return PT.tracked(T.plate_boxes(spark, sf).selectExpr("*", AT), gap=43_200)


@query("ss05_stream_tracked_plates")
def stream_tracked_plates(spark, sf):
    """The same as a stream: tracks that the watermark has not passed yet are not given out."""
    with folds.rocksdb(spark):
        return folds.run_available(PT.tracked_stream(streams.plate_boxes(spark, sf).selectExpr("*", AT), gap=43_200), "plate_tracks")


#: The test events lie hours apart: cooldowns to match.
PEOPLE = {"cooldown": 86_400, "track": 172_800, "moment": 14_400, "reuse": 43_200, "keep": 345_600}
VEHICLES = {"text": 86_400, "look": 43_200, "place": 21_600}


@query("ss10_people")
def people(spark, sf):
    """SS-10: people told by group, track, place and look, and which layer knew them."""
    return persons.people(T.sightings(spark, sf).filter("object_type = 'person'").selectExpr("*", AT), **PEOPLE)


@query("ss10_stream_layers")
def stream_layers(spark, sf):
    with folds.rocksdb(spark):
        return folds.run_available(persons.people_stream(streams.sightings(spark, sf).filter("object_type = 'person'").selectExpr("*", AT), **PEOPLE), "people")


@query("ss09_vehicles")
def vehicles(spark, sf):
    """SS-9: vehicles whose plate, look or place was there lately."""
    return persons.vehicles(T.sightings(spark, sf).filter("object_type = 'vehicle'").selectExpr("*", AT), **VEHICLES)


@query("ss09_stream_vehicles")
def stream_vehicles(spark, sf):
    with folds.rocksdb(spark):
        return folds.run_available(persons.vehicles_stream(streams.sightings(spark, sf).filter("object_type = 'vehicle'").selectExpr("*", AT), **VEHICLES), "vehicles")


#: Ten minutes of a camera are a frame in the test events; gaps to match.
FRAMED = ["*", AT, "cast(floor(unix_micros(created_at) / 600000000D) as bigint) as frame"]
GROUPS = {"gap": 43_200, "switch": 21_600, "expiry": 172_800}
LINKS = {"reuse": 86_400, "match": 43_200, "least": 0.50}


@query("ss01_object_groups")
def object_groups(spark, sf):
    """SS-1 and SS-21 with all gates: groups of a camera's stretch that outlive track numbers."""
    return identities.object_groups(T.sightings(spark, sf).selectExpr(*FRAMED), **GROUPS)


@query("ss01_stream_object_groups")
def stream_object_groups(spark, sf):
    with folds.rocksdb(spark):
        return folds.run_available(identities.object_groups_stream(streams.sightings(spark, sf).selectExpr(*FRAMED), **GROUPS), "groups")


@query("ss02_video_identities")
def video_identities(spark, sf):
    """SS-2: tracks of a video linked to events whose own track is gone."""
    return identities.video_identities(T.sightings(spark, sf).selectExpr(*FRAMED), **LINKS)


@query("ss02_stream_video_identities")
def stream_video_identities(spark, sf):
    """The same as a stream; each video's last frame is given out once the watermark has passed it."""
    with folds.rocksdb(spark):
        return folds.run_available(identities.video_identities_stream(streams.sightings(spark, sf).selectExpr(*FRAMED), **LINKS), "identities")


SCHEDULE = {"workers": 4, "capacity": 2, "interval": 7_200.0, "tick": 3_600.0}


@query("ss14_fair_schedule")
def fair_schedule(spark, sf):
    """SS-14: the newest waiting frame of the cameras served longest ago, two an hour and worker."""
    return schedule.served(T.detections(spark, sf).selectExpr("camera_id", "detection_id as id", AT), **SCHEDULE)


@query("ss14_stream_fair_schedule")
def stream_fair_schedule(spark, sf):
    with folds.rocksdb(spark):
        return folds.run_available(schedule.served_stream(streams.detections(spark, sf).selectExpr("camera_id", "detection_id as id", AT, "created_at"), **SCHEDULE), "schedule")


@query("sc13_job", "select 'finished' as status, count(*) as rows, count_if(object_type = 'vehicle') as vehicles, count(distinct camera_id) as cameras from detections")
def job(spark, sf):
    """SC-13 and AG-22: the events as a job; its status, the metrics observed in its micro-batches, and what its result holds."""
    known = jobs.Jobs(spark, f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex[:12]}")
    try:
        name = known.submit(f"{sf}/events.parquet", lambda _: streams.detections(spark, sf), rows=F.count("*"), vehicles=F.count_if(F.col("object_type") == "vehicle"))
        known.wait(name)
        seen = [p.observedMetrics["job"] for p in known.query(name).recentProgress if "job" in p.observedMetrics]
        cameras = known.result(name).agg(F.count_distinct("camera_id").alias("cameras"))
        return cameras.select(F.lit(known.status(name)).alias("status"), *[F.lit(sum(m[n] for m in seen)).cast("long").alias(n) for n in ("rows", "vehicles")], "cameras")
    finally:
        known.close()


#: What reading vehicles without a plate again gives, in two batches.
AGAIN = "detection_id, detection_id % 3 as seq, case detection_id % 5 when 0 then 'B 1234 CD' when 1 then 'D77X' when 2 then 'OO' end as text, detection_confidence as ocr, detection_id % 7 = 0 as cached, cast(detection_id % 1000 as double) as age"

AGAIN_COLUMNS = AGAIN.split(", ")


@query("ss19_read_again", f""", q as (select detection_id, camera_id, event_key, cast(detection_id % 3 as int) as retries from detections where has_plate = 0 and object_type = 'vehicle'),
a as (select {AGAIN}, case when detection_id % 2 = 0 then 0 else 1 end as batch from detections where has_plate = 0 and object_type = 'vehicle' and detection_id % 11 > 0),
r as (select *, replace(text, ' ', '') as plate, text in ('B 1234 CD', 'D77X') as valid from a), k as (select * from r where case when cached then valid and age <= 600 else valid or ocr >= 0.45 and length(plate) >= 2 end)
select detection_id, case when k.plate is not null then 'read' when q.retries + (a.detection_id is not null)::int < 3 then 'waiting' else 'given up' end as status, case when k.plate is null then q.retries + (a.detection_id is not null)::int else q.retries end::int as retries, k.plate
from q left join a using (detection_id) left join (select detection_id, plate from k) k using (detection_id)""")
def read_again(spark, sf):
    """SS-19: vehicles without a plate read again in two batches, the first of which comes twice."""
    rows = T.detections(spark, sf).filter("has_plate = 0 and object_type = 'vehicle'")
    first = rows.selectExpr("detection_id", "camera_id", "event_key", "cast(detection_id % 3 as int) as retries")
    queue = requeue.Queue(spark, f"{shared_folder(spark)}/queue-{uuid.uuid4().hex[:12]}")
    queue.start(first)
    again = rows.filter("detection_id % 11 > 0")
    results = [again.filter(f"detection_id % 2 {sign} 0").selectExpr(*AGAIN_COLUMNS) for sign in ("=", "<>")]
    for batch, n in ((results[0], 0), (results[0], 0), (results[1], 1)):
        queue.apply(batch, n)
    found = queue.latest().selectExpr("detection_id", "'waiting' as status", "retries", "cast(null as string) as plate").unionByName(queue.read().selectExpr("detection_id", "'read' as status", "retries", "plate"))
    gone = first.join(found, "detection_id", "left_anti").selectExpr("detection_id", "'given up' as status", "cast(3 as int) as retries", "cast(null as string) as plate")
    return found.unionByName(gone)
