"""Groups, identities and schedules against plain walks, and as streams over several micro-batches."""

from __future__ import annotations

import random
from collections import Counter
from math import hypot

import pytest

from gatewatch.streaming import folds, identities, schedule

SCHEMA = "camera_id long, id long, at double, frame long, object_type string, kind string, track long, hash string, x1 double, y1 double, x2 double, y2 double"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
T0 = 1_790_000_000.0


def frames(seed, n=260, cameras=2):
    """Objects that drift, some under a new track number now and then, with silences."""
    r = random.Random(seed)
    out, i, at = [], 0, T0
    things = [{"c": r.randrange(cameras), "type": r.choice(["vehicle", "vehicle", "person"]), "kind": r.choice(["car", "bus"]), "x": r.randrange(500), "y": r.randrange(300), "w": r.choice([60, 100]), "track": k, "look": r.getrandbits(64)} for k in range(12)]
    for f in range(n):
        at += r.choice([0.2, 0.2, 0.5, 1.0, 2.0 if r.random() < 0.2 else 0.3, 30.0 if r.random() < 0.2 else 0.2])
        for t in r.sample(things, r.randrange(0, 8)):
            t["x"], t["y"] = t["x"] + r.randrange(-9, 10), t["y"] + r.randrange(-6, 7)
            if r.random() < 0.15:
                t["track"] = r.choice([r.randrange(12, 200), -1, None])
            if r.random() < 0.03:
                t["x"] = r.randrange(500)
            look = t["look"]
            for _ in range(r.choice([0, 3, 9, 20])):
                look ^= 1 << r.randrange(64)
            out.append((t["c"], i, round(at, 3), f, t["type"], t["kind"], t["track"], f"{look:016x}" if r.random() < 0.6 else None, float(t["x"]), float(t["y"]), float(t["x"] + t["w"]), float(t["y"] + t["w"])))
            i += 1
    return out


def iou(a, b):
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0


def by_camera(rows, *more):
    keys = sorted({tuple(r[NAMES.index(k)] for k in ("camera_id", *more)) for r in rows})
    for k in keys:
        yield k, sorted((dict(zip(NAMES, r)) for r in rows if tuple(r[NAMES.index(n)] for n in ("camera_id", *more)) == k), key=lambda r: (r["at"], r["id"]))


def plain_groups(rows):
    """id -> (all ids of its group so far counted from the first, switched)."""
    out = {}
    for _, mine in by_camera(rows):
        groups = []
        for d in mine:
            tid, person = -1 if d["track"] is None else d["track"], d["object_type"] == "person"
            top = 130 if person else 120
            scored = []
            for n, g in enumerate(groups):
                b = g["box"]
                dt = d["at"] - b["at"]
                if g["frame"] == d["frame"] or b["object_type"] != d["object_type"] or dt > 8:
                    continue
                dist = hypot((d["x1"] + d["x2"] - b["x1"] - b["x2"]) / 2, (d["y1"] + d["y2"] - b["y1"] - b["y2"]) / 2)
                over = iou(d, b)
                sa, sb = (d["x2"] - d["x1"]) * (d["y2"] - d["y1"]), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
                if tid >= 0 and tid in g["tracks"] and (dist <= top * 1.5 or over > 0):
                    scored.append((1000 - dist, -n, False))
                    continue
                known = tid >= 0 and tid in g["tracks"]
                if not person and not known and (dt > 1.5 or g["kind"] != d["kind"] or over < 0.65 or dist > max(30, 0.25 * max(d["x2"] - d["x1"], d["y2"] - d["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]))):
                    continue
                if dist > top or abs(sa - sb) / max(sa, sb) > 0.5:
                    continue
                h = bin(int(d["hash"], 16) ^ int(g["hash"], 16)).count("1") if person and d["hash"] and g["hash"] else None
                if h is not None and h > 16:
                    continue
                if not (h is not None and h <= 8) and over < 0.15 and dist > 0.65 * top:
                    continue
                last = -1 if b["track"] is None else b["track"]
                scored.append((over * 100 + 100 - dist / top * 50, -n, last != tid and last >= 0 and tid >= 0))
            if scored:
                _, n, switched = max(scored)
                g = groups[-n]
            else:
                g, switched = {"first": d["id"], "tracks": set(), "hash": None, "kind": d["kind"]}, False
                groups.append(g)
            g["box"], g["frame"] = d, d["frame"]
            g["tracks"] |= {tid} - {-1}
            g["hash"] = d["hash"] if person and d["hash"] else g["hash"]
            out[d["id"]] = (g["first"], switched)
    return out


def plain_identities(rows):
    out = {}
    for _, mine in by_camera(rows, "object_type"):
        events, link, gens = [], {}, {}
        for frame in sorted({(d["frame"]) for d in mine}):
            now = [d for d in mine if d["frame"] == frame]
            here = {d["track"] for d in now} - {None, -1}
            for d in now:
                if d["track"] in (None, -1):
                    continue
                e = link.get(d["track"])
                if e is not None and (e not in events or d["at"] - e["box"]["at"] > 8):
                    e = None
                if e is None:
                    free = [x for x in events if d["at"] - x["box"]["at"] <= 1.5 and x["box"]["frame"] != frame and x["box"]["track"] not in here and x["kind"] == d["kind"]]
                    best = max(free, key=lambda x: iou(d, x["box"]), default=None)
                    e = best if best and iou(d, best["box"]) >= 0.7 else None
                started = e is None
                if started:
                    g, last = gens.get(d["track"], (0, None))
                    gens[d["track"]] = g, last = (1 if last is None else g + (d["at"] - last > 8), d["at"])
                    e = {"track": d["track"], "generation": g, "kind": d["kind"]}
                    events.append(e)
                link[d["track"]] = e
                e["box"] = d
                out[d["id"]] = (e["track"], e["generation"], started)
            events = [e for e in events if now[-1]["at"] - e["box"]["at"] <= 32]
    return out


def firsts(rows):
    """id -> (first id of its group, switched), from group numbers."""
    first = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault((r["c"], r["stretch_start"], r["group_no"]), r["id"])
    return {r["id"]: (first[r["c"], r["stretch_start"], r["group_no"]], r["switched"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_a_walk(spark, seed):
    rows = frames(seed)
    camera = {r[1]: r[0] for r in rows}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [r.asDict() | {"c": camera[r["id"]]} for r in identities.object_groups(df).collect()]
    want = plain_groups(rows)
    assert firsts(got) == want and sum(s for _, s in want.values()) > 3
    keys = identities.stretches(df, 8).select("camera_id", "stretch").distinct().count()
    assert keys > 6 > 2  # more than cameras


@pytest.mark.parametrize("seed", [3, 4])
def test_identities_against_a_walk(spark, seed):
    rows = frames(seed)
    got = {r["id"]: (r["event_track"], r["generation"], r["started"]) for r in identities.video_identities(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = plain_identities(rows)
    assert got == want and any(track != r[6] for r in rows for track, _, _ in [want.get(r[1], (r[6], 0, 0))]) and max(g for _, g, _ in want.values()) > 1


def streamed(spark, tmp_path, rows, schema, make, n=6):
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).selectExpr("*", "timestamp_micros(cast(at * 1000000 as long)) as created_at").coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/00").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("created_at", "1 second")
    with folds.rocksdb(spark):
        return folds.run_available(make(stream), "walk").collect()


def test_groups_as_a_stream(spark, tmp_path):
    rows = frames(5, 150)
    camera = {r[1]: r[0] for r in rows}
    got = [r.asDict() | {"c": camera[r["id"]]} for r in streamed(spark, tmp_path, rows, SCHEMA, identities.object_groups_stream)]
    assert firsts(got) == plain_groups(rows)


def test_identities_as_a_stream(spark, tmp_path):
    rows = frames(6, 150)
    rows += [(c, 10**6 + i, T0 + 10**5, 10**6, kind, "none", None, None, 0.0, 0.0, 1.0, 1.0) for i, (c, kind) in enumerate((c, k) for c in (0, 1) for k in ("vehicle", "person"))]  # moves the watermark on
    got = {r["id"]: (r["event_track"], r["generation"], r["started"]) for r in streamed(spark, tmp_path, rows, SCHEMA, identities.video_identities_stream)}
    assert got == plain_identities(rows)


# schedule

FRAMES = "camera_id long, id long, at double"


def plain_schedule(rows, workers, capacity, interval, tick):
    """Every tick in turn."""
    out = []
    for w in range(workers):
        mine = sorted((r for r in rows if r[0] % workers == w), key=lambda r: (r[2], r[1]))
        if not mine:
            continue
        waiting, served = {}, {}
        for t in range(int(mine[0][2] // tick), int(mine[-1][2] // tick) + 400):
            for c, i, at in mine:
                if at // tick == t:
                    waiting[c] = (i, at, waiting[c][2] + 1 if c in waiting else 0)
            end = (t + 1) * tick
            for c in sorted((c for c in waiting if end - served.get(c, -1e18) >= interval), key=lambda c: (served.get(c, -1e18), c))[:capacity]:
                i, at, replaced = waiting.pop(c)
                served[c] = end
                out.append((w, t, c, i, round(end - at, 6), replaced))
    return sorted(out)


def traffic(seed, n=500):
    """Two busy cameras of a worker and one that shows a frame only now and then."""
    r = random.Random(seed)
    out, at = [], 1000.0
    for i in range(n):
        at += r.choice([0.1, 0.2, 0.6, 7.0 if r.random() < 0.03 else 0.2])
        out.append((8 if r.random() < 0.03 else r.choice([0, 4, 1, 5, 9, 2]), i, round(at, 3)))
    return out


@pytest.mark.parametrize("capacity, interval", [(1, 0.0), (2, 0.0), (1, 3.5)])
def test_schedule_against_every_tick(spark, capacity, interval):
    rows = traffic(7)
    got = sorted(tuple(r) for r in schedule.served(spark.createDataFrame(rows, FRAMES).repartition(3), 4, capacity=capacity, interval=interval).collect())
    assert got == plain_schedule(rows, 4, capacity, interval, 1.0)


def test_no_camera_starves(spark):
    """A camera with one frame is served in the turn that is its due, however many frames the others have."""
    rows = [(c, t * 10 + k, 100.0 + t + c / 100) for t in range(30) for k, c in enumerate((0, 4, 8))] + [(12, 9999, 105.5)]
    got = schedule.served(spark.createDataFrame(rows, FRAMES), 4).collect()
    assert next(r["waited"] for r in got if r["camera_id"] == 12) <= 1.0  # never served before: first in line
    turns = Counter(r["camera_id"] for r in got)
    assert max(turns[c] for c in (0, 4, 8)) - min(turns[c] for c in (0, 4, 8)) <= 1


def test_schedule_as_a_stream(spark, tmp_path):
    rows = [*traffic(8, 200)]
    rows += [(c, 10**6 + c, 9000.0) for c in range(4)]
    got = sorted(tuple(r) for r in streamed(spark, tmp_path, rows, FRAMES, lambda s: schedule.served_stream(s, 4)))
    assert got == [x for x in plain_schedule(rows, 4, 1, 0.0, 1.0) if x[3] < 10**6]
