"""De-duplication, sessions, merges, joins and summaries on small tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from gatewatch.functions import geometry as G
from gatewatch.operators import analytics, dedup, dml, joins, listing, merge, sessions

T0 = datetime(2026, 10, 22, 10)


def test_greedy_plates(spark):
    rows = [(101, "AB1234CD", 0.95, "vehicle:1:group_1", 2), (102, "AB1234CD", 0.70, "vehicle:1:group_2", 0), (103, "AB1234CD", 0.92, "vehicle:1:group_10", 900), (104, "B5678EF", 0.88, "vehicle:1:group_3", 4)]
    df = spark.createDataFrame([(i, 1, p, o, 0.5, k, T0 + timedelta(seconds=s)) for i, p, o, k, s in rows], "plate_id long, camera_id long, plate_number string, ocr_confidence double, quality double, event_key string, created_at timestamp")
    assert {r["plate_id"] for r in dedup.greedy_plates(df).collect()} == {101, 103, 104}


def test_greedy_plates_against_a_walk(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.randrange(3), r.choice(["A1", "B2", "C3", "-", None]), r.random(), r.random(), r.choice(["x", "y", "z", None, ""]), T0 + timedelta(seconds=r.randrange(200))) for i in range(150)]
    df = spark.createDataFrame(rows, "plate_id long, camera_id long, plate_number string, ocr_confidence double, quality double, event_key string, created_at timestamp")
    seen, plates, want = set(), [], set()
    for i, cam, plate, _, _, key, at in sorted(rows, key=lambda x: (x[3], x[4], x[6], x[0]), reverse=True):
        real = plate not in (None, "-")
        if real and any(p == plate and c == cam and abs((at - t).total_seconds()) <= 25 for p, c, t in plates):
            continue
        k = ("event", cam, key) if key else ("plate", i)
        if k not in seen:
            seen.add(k)
            want.add(i)
            if real:
                plates.append((plate, cam, at))
    assert {x["plate_id"] for x in dedup.greedy_plates(df).collect()} == want


def _track(spark, rows):
    return spark.createDataFrame([(i, "P", c, T0 + timedelta(seconds=s)) for i, (c, s) in enumerate(rows)], "detection_id long, plate string, camera_id long, created_at timestamp")


def test_sessions(spark):
    assert sessions.sessions(_track(spark, [(1, 0), (2, 30), (1, 60)]), "plate", 90).count() == 3
    assert sessions.sessions(_track(spark, [(1, 0), (1, 90)]), "plate", 90).count() == 1
    assert sessions.sessions(_track(spark, [(1, 0), (1, 90.001)]), "plate", 90).count() == 2


def test_hours_of_nothing(spark):
    none = spark.createDataFrame([], "created_at timestamp, object_type string")
    rows = analytics.hourly(none).collect()
    assert len(rows) == 24 and sum(r["vehicles"] for r in rows) == 0


def _reading(seq, **kw):
    base = {"event_key": "k", "seq": seq, "plate": "B1234CD", "ocr": 0.8, "consensus": 0.8, "quality": 0.8, "stable": True, "vehicle_confidence": 0.5, "has_driver": False, "direction": "unknown", "vehicle_type": "car", "image": None}
    return tuple({**base, **kw}.values())


SCHEMA = "event_key string, seq long, plate string, ocr double, consensus double, quality double, stable boolean, vehicle_confidence double, has_driver boolean, direction string, vehicle_type string, image string"


def test_merge_keeps_a_better_plate(spark):
    rows = [_reading(1, ocr=0.85, consensus=0.95, quality=0.90), _reading(2, plate="D9999ZZ", ocr=0.99, consensus=0.45, quality=0.20)]
    e = merge.merged_events(spark.createDataFrame(rows, SCHEMA)).first()
    assert (e["plate"], e["n_readings"], e["n_changes"]) == ("B1234CD", 2, 1)


def test_merge_takes_a_better_reading(spark):
    rows = [_reading(1, ocr=0.70, consensus=0.80, quality=0.45), _reading(2, ocr=0.72, consensus=0.82, quality=0.95, direction="entry", image="a.jpg")]
    e = merge.merged_events(spark.createDataFrame(rows, SCHEMA)).first()
    assert (e["quality"], e["direction"], e["image"], e["n_changes"]) == (0.95, "entry", "a.jpg", 2)


def test_merge_without_a_plate(spark):
    rows = [_reading(1, plate=None, vehicle_confidence=0.75), _reading(2, event_key="failed", plate="OA", ocr=0.99, vehicle_confidence=0.75)]
    found = {e["event_key"]: e for e in merge.merged_events(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["k"]["plate"] is None and found["k"]["status"] == 1
    e = found["failed"]  # seen and failed: no plate, but its text and confidence stay
    assert (e["plate"], e["raw_text"], e["status"], e["detection_confidence"]) == (None, "OA", 0, 0.99)


def test_merge_keeps_a_picture_until_a_clearer_one(spark):
    rows = [_reading(1, image="a.jpg", vehicle_confidence=0.5), _reading(2, image="b.jpg", direction="exit", vehicle_confidence=0.5), _reading(3, image="c.jpg", vehicle_confidence=0.6)]
    events = [merge.merged_events(spark.createDataFrame(rows[:n], SCHEMA)).first() for n in (2, 3)]
    assert [(e["image"], e["direction"], e["n_changes"]) for e in events] == [("a.jpg", "exit", 2), ("c.jpg", "exit", 3)]


def test_merge_keeps_the_text_of_a_failed_plate(spark):
    rows = [_reading(1, plate="OA", ocr=0.9), _reading(2, plate=None), _reading(3)]
    events = [merge.merged_events(spark.createDataFrame(rows[:n], SCHEMA)).first() for n in (2, 3)]
    assert [(e["plate"], e["raw_text"], e["n_changes"]) for e in events] == [(None, "OA", 1), ("B1234CD", "B1234CD", 2)]


def test_merge_of_persons_and_of_rows_without_a_key(spark):
    faces = [(1, 0.5, "1.jpg"), (2, 0.54, "2.jpg"), (3, 0.7, None), (4, 0.6, "4.jpg")]
    rows = [(*_reading(n), "person", c, i) for n, c, i in faces] + [(None, *_reading(n)[1:], "vehicle", None, None) for n in (5, 6)]
    found = merge.merged_events(spark.createDataFrame(rows, SCHEMA + ", object_type string, face_confidence double, face_image string")).collect()
    person = next(e for e in found if e["object_type"] == "person")
    assert (person["face_confidence"], person["face_image"], person["status"], person["plate"], person["n_readings"], person["n_changes"]) == (0.6, "4.jpg", 2, None, 4, 2)
    assert [(e["event_key"], e["plate"], e["n_readings"]) for e in found if e["object_type"] == "vehicle"] == [(None, "B1234CD", 1)] * 2


def test_hamming_six_and_seven(spark):
    h = lambda n: f"{(1 << n) - 1:016x}"
    rows = [(1, 1, "car", h(0), T0), (2, 1, "car", h(6), T0 + timedelta(seconds=5)), (3, 1, "car", h(7), T0 + timedelta(seconds=3000))]
    df = spark.createDataFrame(rows, schema := "id long, camera_id long, object_type string, hash string, created_at timestamp")
    assert [(r["id"], r["other"]) for r in joins.similar_hashes(df, df).collect()] == [(2, 1)]
    more = spark.createDataFrame([*rows, (4, 1, "car", h(3), T0 + timedelta(seconds=6)), (5, 1, "person", h(3), T0 + timedelta(seconds=7))], schema)
    assert sorted((r["id"], r["other"]) for r in joins.similar_hashes(more, more).collect()) == [(2, 1), (4, 2)]  # the newest, of its type
    near = df.withColumn("created_at", F.lit(T0))
    assert (3, 1) not in {(r["id"], r["other"]) for r in joins.similar_hashes(near, near).collect()}


def test_zones(spark):
    near = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0.6), (1, 0.6), (1, 1), (0, 1))])
    df = spark.createDataFrame([(0.1, 0.7, 0.3, 0.9), (0.1, 0.05, 0.3, 0.2)], "x1 double, y1 double, x2 double, y2 double")
    assert [r[0] for r in df.select(G.zone_of(G.box(), near, F.lit(None).cast("array<array<double>>"))).collect()] == ["NEAR", "FAR"]
    cross = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0))])
    assert spark.range(1).select(G.polygon_problem(cross), G.polygon_problem(near)).first()[:2] == ("crosses itself", None)


def test_periods():
    as_of = date(2024, 1, 20)
    assert listing.period("7d", as_of) == ("7d", date(2024, 1, 14), as_of)
    assert listing.period("yesterday", as_of) == ("yesterday", date(2024, 1, 19), date(2024, 1, 19))
    assert listing.period("all", as_of) == ("all", None, None) and listing.period("odd", as_of)[0] == "custom"


def test_settings_and_retries(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 1)], "key string, value string, seq int")
    assert {(r["key"], r["value"]) for r in dml.upsert_settings(old, new).collect()} == {("a", "1"), ("b", "4"), ("c", "5")}


def test_captures_and_sizes(spark, tmp_path):
    import json

    from gatewatch.sources import scans

    (tmp_path / "a.json").write_text(json.dumps({"base_name": "a", "track_id": 3, "candidates": [{"text": "B1", "confidence": 0.5}]}))
    r = scans.captures(spark, str(tmp_path)).first()
    assert r["track_id"] == 3 and r["candidates"][0]["text"] == "B1"
    assert scans.file_sizes(spark, str(tmp_path)).first()["files"] == 1


def test_reports_are_written(spark, tmp_path):
    from gatewatch.operators import reports

    table = spark.createDataFrame([(1, None, 1, "entry")], "camera_id long, location string, status int, direction string")
    for kind in ("csv", "json", "parquet"):
        reports.write(reports.cameras(table), f"{tmp_path}/{kind}", kind)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["status"] == "Aktif"


def test_best_plates_by_tier(spark):
    """A plate by group beats one by place; where the plates by group are not ready the vehicle has none; generations must agree."""
    v = [(1, 1, 10, 7, None, 1, 0.0, 0.0, 9.0, 9.0), (1, 1, 11, 8, 3, 2, 0.0, 0.0, 9.0, 9.0), (1, 1, 12, None, 4, None, 50.0, 0.0, 59.0, 9.0), (1, 1, 13, None, None, None, 0.0, 0.0, 9.0, 9.0), (1, 2, 14, 7, 4, 1, 0.0, 0.0, 9.0, 9.0)]
    p = [(1, 1, 20, 7, None, None, False, 0.9), (1, 1, 21, 7, None, 2, True, 0.9), (1, 1, 22, None, 3, 2, True, 0.1), (1, 1, 23, None, 4, 5, True, 0.2), (1, 1, 24, None, 4, None, True, 0.1), (1, 1, 25, None, None, None, True, 0.9), (1, 1, 26, None, None, None, False, 1.0)]
    vehicles = spark.createDataFrame(v, "camera_id long, frame long, id long, vehicle_group long, track long, generation long, x1 double, y1 double, x2 double, y2 double")
    plates = spark.createDataFrame([(c, f, i, g, t, n, 1.0, 1.0, 3.0, 2.0, ready, False, True, s, 0.5) for c, f, i, g, t, n, ready, s in p], "camera_id long, frame long, id long, vehicle_group long, track long, generation long, x1 double, y1 double, x2 double, y2 double, ready boolean, stable boolean, valid boolean, score double, confidence double")
    assert sorted(tuple(r) for r in joins.best_plates(vehicles, plates).collect()) == [(11, 22, "track"), (12, 23, "track"), (13, 25, "place")]


def test_captures_are_looked_up_once_a_wanted_row(spark):
    """Rows that share an id each get their capture, as in SQL; of 20,000 captures of one key only the newest meets the 20,000 wanted rows."""
    wanted = spark.createDataFrame([(1, "a", 7), (1, "b", 7), (2, None, 7), (3, "b", 8)], "id long, event_key string, track_id long")
    captures = spark.createDataFrame([(10, "a", 7, T0), (11, "a", 9, T0 + timedelta(seconds=5)), (12, "a", 9, T0 + timedelta(seconds=5)), (13, None, 7, T0 + timedelta(seconds=1))], "capture_id long, event_key string, track_id long, created_at timestamp")
    found = joins.capture_lookup(wanted, captures, ["event_key", "track_id"])
    assert sorted((r["id"], r["capture_id"]) for r in found.collect()) == [(1, 12), (1, 13), (2, 13)]
    many = spark.range(20_000).selectExpr("id", "'k' as event_key", "1L as track_id")
    newest = joins.capture_lookup(many, many.selectExpr("id as capture_id", "event_key", "track_id", "timestamp_seconds(id) as created_at"), ["event_key", "track_id"])
    assert newest.groupBy("capture_id").count().collect() == [(19_999, 20_000)]


def test_similar_hashes_are_walked_not_joined(spark):
    """Against all pairs, with ties of time, repeated ids and nulls; no pair is shuffled."""
    import random

    r = random.Random(8)
    looks = [r.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(700):
        look = r.choice(looks)
        for _ in range(r.choice([0, 2, 4, 7])):
            look ^= 1 << r.randrange(64)
        rows.append((i if r.random() < 0.97 else i - 1, r.choice([1, 2, None]), r.choice(["car", "person"]), f"{look:016x}" if r.random() < 0.95 else None, T0 + timedelta(seconds=r.randrange(9000))))
    df = spark.createDataFrame(rows, "id long, camera_id long, object_type string, hash string, created_at timestamp").repartition(5)
    want = {}
    for a in rows:
        near = [(b[4], b[0]) for b in rows if a[1] is not None and a[1:3] == b[1:3] and a[0] != b[0] and a[3] and b[3] and 0 <= (a[4] - b[4]).total_seconds() <= 1800 and (int(a[3], 16) ^ int(b[3], 16)).bit_count() <= 6]
        if near:
            want[a[0]] = max(want.get(a[0], (T0, -1)), max(near))
    found = joins.similar_hashes(df, df)
    assert sorted((x["id"], x["other"]) for x in found.collect()) == sorted((i, other) for i, (_, other) in want.items())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
