"""Folds: batch twin and stream give the same rows."""

from __future__ import annotations

import pytest

from gatewatch import catalog
from gatewatch.streaming import trackers as K


def _run(step, rows):
    state, out = None, []
    for r in rows:
        state, more = step(state, r)
        out += more
    return out


def test_generation_gap():
    out = _run(K.generation(8), [{"id": i, "at": t} for i, t in enumerate((0, 8, 16.001, 10))])
    assert [r["generation"] for r in out] == [0, 0, 1, 2]


@pytest.mark.parametrize(("way", "sides", "want"), [("entry", (1, -1), "entry"), ("entry", (-1, 1), "exit"), ("exit", (1, -1), "exit"), ("exit", (1, 0, -1), "exit"), ("unknown", (1, -1), "unknown")])
def test_crossing(way, sides, want):
    out = _run(K.crossing(), [{"id": i, "side": s, "camera_direction": way, "outside": 1} for i, s in enumerate(sides)])
    assert out[-1]["direction"] == want and out[0]["direction"] == "unknown"


def test_cooldown():
    rows = [{"id": i, "at": t} for i, t in enumerate((0, 50, 100, 150))]
    assert [r["id"] for r in _run(K.cooldown(60), rows)] == [0, 2]
    assert [r["id"] for r in _run(K.cooldown(60, refresh=True), rows)] == [0]


def test_grouping_survives_a_new_track_id():
    box = {"x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0, "kind": "car"}
    rows = [{"id": 1, "track": 5, "at": 0.0, "frame": 1, **box}, {"id": 2, "track": 9, "at": 1.0, "frame": 2, **box}, {"id": 3, "track": 9, "at": 20.0, "frame": 3, **box}]
    assert [(r["object"], r["switched"]) for r in _run(K.grouping(), rows)] == [(1, False), (1, True), (2, False)]


def test_stream_equals_batch(spark, sf):
    queries = catalog.queries()
    rows = lambda name: sorted(tuple(r) for r in queries[name](spark, sf).collect())
    assert rows("ss03_stream_generations") == rows("ss03_generations")


@pytest.mark.parametrize("name", ["ss09", "ss18"])
def test_other_streams_equal_their_twins(spark, sf, name):
    queries, twin = catalog.queries(), {"ss09": ("ss09_stream_cooldown", "ss09_cooldown"), "ss18": ("ss18_stream_focus", "ss18_focus")}[name]
    got, want = (sorted(tuple(r) for r in queries[n](spark, sf).collect()) for n in twin)
    assert got == want


TWINS = {"ss01_stream_grouping": "ss01_grouping", "ss09_stream_cooldown": "ss09_cooldown", "ss10_stream_people": "ss10_person_filter", "ss12_stream_improvements": "ss12_improvements", "ss18_stream_focus": "ss18_focus"}


@pytest.fixture(scope="module")
def many_files(spark, sf, tmp_path_factory):
    """The events in 17 files by time, which a stream reads in three micro-batches."""
    import os

    folder = tmp_path_factory.mktemp("files")
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(17, "ts", "event_id").write.parquet(f"{folder}/events.parquet")
    parts = sorted(f for f in os.listdir(f"{folder}/events.parquet") if f.startswith("part-"))
    for k, part in enumerate(parts):
        os.utime(f"{folder}/events.parquet/{part}", (1_700_000_000 + 10 * k,) * 2)
    assert len(parts) > 16
    return str(folder)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_streams_over_several_batches_equal_their_twins(spark, many_files, name):
    """ss03 counts from a track's first row, which its state outlives only for the time to live: its own test is below."""
    queries = catalog.queries()
    got, want = (sorted(tuple(r) for r in queries[n](spark, many_files).collect()) for n in (name, TWINS[name]))
    assert want and got == want


def test_state_lives_by_event_time(spark, tmp_path):
    """Four files, one a micro-batch: a track that is absent for two of them keeps its generation; one that is away beyond the
    time to live starts anew, after `final` was called for it."""
    import os

    from gatewatch.streaming import folds

    base = 1_700_000_000
    batches = [[(1, 1, 0), (2, 2, 0), (3, 1, 90_000)], [(4, 2, 90_100)], [(5, 2, 90_200)], [(6, 1, 91_500), (7, 2, 400_000)], [(8, 2, 400_001)], [(9, 1, 400_002)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, track, float(base + at)) for i, track, at in rows], "id long, track long, at double").selectExpr("*", "timestamp_seconds(at) as created_at")
        df.coalesce(1).write.parquet(f"{tmp_path}/x{k}")
        part = next(f for f in os.listdir(f"{tmp_path}/x{k}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/x{k}/{part}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (base + 10 * k, base + 10 * k))
    stream = spark.readStream.schema("id long, track long, at double, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("created_at", "0 seconds")
    final = lambda state: [{"id": -1, "generation": state["generation"]}]
    out = folds.run_available(folds.fold_stream(stream, ["track"], ["at", "id"], K.generation(86_400), "id long, generation long", 172_800_000, final), "expiry")
    got = sorted((r["id"], r["generation"]) for r in out.collect())
    every = spark.read.parquet(f"{tmp_path}/in").filter("id <= 6")
    twin = sorted((r["id"], r["generation"]) for r in folds.fold_batch(every, ["track"], ["at", "id"], K.generation(86_400), "id long, generation long").collect())
    assert [r for r in got if 0 < r[0] <= 6] == twin and dict(twin)[6] == 1
    assert dict(got)[9] == 0 and got[0] == (-1, 1)


def test_rows_of_a_micro_batch_wait_in_columns():
    """Streams sort a key's rows of a micro-batch without making each a dictionary first: 200,000 rows take less than 60 MB; types, nulls and ties stay."""
    import random
    import tracemalloc

    import pandas as pd
    from pyspark.sql import Row

    from gatewatch.streaming import folds, walks

    r = random.Random(7)
    few = [Row(at=float(r.randrange(50)), id=r.randrange(9), track=r.choice([None, 3]), text=r.choice([None, f"t{k}"]), ok=r.choice([None, True])) for k in range(25_000)]
    want = sorted((x.asDict() for x in few), key=lambda x: (x["at"], x["id"]))
    assert list(walks.in_order(iter(few), ["at", "id"])) == want
    parts = [pd.DataFrame([x.asDict() for x in few[i : i + 7000]]) for i in range(0, 25_000, 7000)]
    assert [folds._clean(x) for some in folds.in_order(iter(parts), ["at", "id"]) for x in some.to_dict("records")] == want
    assert list(walks.in_order(iter([]), ["at"])) == []
    make = (Row(at=float(-k), id=k, track=k % 5, text=f"text {k}", ok=True) for k in range(200_000))
    tracemalloc.start()
    assert sum(1 for _ in walks.in_order(make, ["at", "id"])) == 200_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_a_late_row_still_finds_its_group():
    """What can't be joined any more is forgotten, but not so soon that a row of the watermark's delay would miss it."""
    from gatewatch.streaming.identities import ObjectGroups

    box = {"object_type": "vehicle", "kind": "car", "track": 1, "hash": None, "x1": 0.0, "y1": 0.0, "x2": 50.0, "y2": 50.0}
    walk = ObjectGroups(gap=43_200, switch=21_600, expiry=172_800)
    numbers = [walk.take(box | {"id": i, "at": at, "frame": i} | more)[0]["group_no"] for i, (at, more) in enumerate([(0.0, {}), (43_500.0, {"x1": 900.0, "x2": 950.0}), (43_100.0, {}), (200_000.0, {})])]
    assert numbers == [1, 2, 1, 3]
    again = ObjectGroups(gap=43_200, switch=21_600, expiry=172_800)
    again.load(walk.dump())
    assert [g["no"] for g in again.groups] == [3] and again.due() == 200_000.0 + 46_800


def test_grouping_state_is_plain_again():
    """Objects lie in arrays while a micro-batch is walked, and go into the state store and back as JSON."""
    import json

    box = {"x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0, "kind": "car"}
    rows = [{"id": i, "track": None if i % 3 else i, "at": float(i), "frame": i // 2, **box} for i in range(300)]
    step, state, out = K.grouping(gap=8, expiry=240), None, []
    for row in rows:
        state, more = step(state, row)
        assert isinstance(state, K.Objects)
        state, out = json.loads(json.dumps(state.plain())), out + more
    assert out == _run(K.grouping(gap=8, expiry=240), rows) and [r["object"] for r in out[:4]] == [1, 2, 2, 1]


def _late(spark, folder, seconds, name="late", per=1):
    from gatewatch.streaming import folds, streams

    d = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", per).parquet(folder).withWatermark("created_at", "10 minutes")
    return folds.run_available(streams.late_plates(d.filter("object_type = 'vehicle'"), d.filter("plate_id is not null"), seconds), name)


def test_late_plates_over_several_batches(spark, tmp_path):
    """Vehicles with every plate of their span, whichever came first, and those without one once their span has passed; without camera or track there is none."""
    import os
    import random
    from datetime import datetime, timedelta, timezone

    r, base, rows = random.Random(5), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for k in range(5):  # files overlap by less than the watermark's delay, so no row is too late
        some = [
            (len(rows) + i if r.random() < 0.97 else None, len(rows) + i if r.random() < 0.4 else None, r.choice([1, 2, None]), r.choice([1, 2, None]), "vehicle" if r.random() < 0.7 else "person", base + timedelta(seconds=k * 1200 + r.randrange(-599, 1) + r.randrange(1, 1200)))
            for i in range(120)
        ]
        rows += some
        spark.createDataFrame(some, "detection_id long, plate_id long, camera_id long, track_id long, object_type string, created_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/x{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/x{k}/{next(f for f in os.listdir(f'{tmp_path}/x{k}') if f.endswith('.parquet'))}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    span, want = timedelta(seconds=900), []
    # filters lie below the watermarks, and the slower side's holds
    passed = min(max(x[5] for x in rows if x[4] == "vehicle"), max(x[5] for x in rows if x[1] is not None and None not in x[2:4])) - timedelta(minutes=10)
    for v in (x for x in rows if x[4] == "vehicle"):
        near = [p[1] for p in rows if p[1] is not None and None not in v[2:4] and p[2:4] == v[2:4] and v[5] <= p[5] <= v[5] + span]
        want += [(v[0], p) for p in near] or [(v[0], None)] * (v[5] + span <= passed)
    got = [tuple(x) for x in _late(spark, f"{tmp_path}/in", 900).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(p is None for _, p in got) > 50 and sum(v is None for v, _ in got) > 3


def test_late_plates_do_not_meet_all_of_their_key(spark, tmp_path):
    """15,000 rows of one track, an hour apart, in one micro-batch: each meets its own plate only, not 225 million others."""
    import time

    rows = spark.range(15_000).selectExpr("id as detection_id", "id as plate_id", "1L as camera_id", "1L as track_id", "'vehicle' as object_type", "timestamp_seconds(1700000000 + id * 3600) as created_at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    began = time.time()
    assert _late(spark, f"{tmp_path}/in", 1800).filter("vehicle = reading").count() == 15_000
    assert time.time() - began < 40


def test_late_pairs_come_by_the_step():
    import numpy as np

    from gatewatch.streaming import late

    r = np.random.default_rng(2)
    at, plates = np.sort(r.integers(0, 1000, 60)), np.sort(r.integers(0, 1000, 80))
    first, count = late.reach(at, plates, 100)
    want = [(i, j) for i, a in enumerate(at) for j, p in enumerate(plates) if a <= p <= a + 100]
    for step in (1, 7, 10_000):
        parts = list(late.pairs(first, count, step))
        assert [(i, j) for v, p in parts for i, j in zip(v.tolist(), p.tolist())] == want and max(len(v) for v, _ in parts) <= step
    assert not list(late.pairs(*late.reach(at, plates[:0], 100)))


def test_late_plates_of_far_times(spark, tmp_path):
    """Times that pandas doesn't know are told apart as others are."""
    rows = "(1, 1, '2500-01-01 00:00:00'), (2, 2, '2500-01-01 00:10:00'), (3, 3, '2500-01-02 00:00:00'), (4, null, '2024-01-01 00:00:00')"
    spark.sql(f"select int(a) as detection_id, int(b) as plate_id, 1L as camera_id, 1L as track_id, 'vehicle' as object_type, timestamp(c) as created_at from values {rows} as t(a, b, c)").coalesce(1).write.parquet(f"{tmp_path}/in")
    assert sorted((tuple(x) for x in _late(spark, f"{tmp_path}/in", 900).collect()), key=repr) == [(1, 1), (1, 2), (2, 2), (3, 3), (4, None)]
