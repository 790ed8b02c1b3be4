"""The layers of SS-9 and SS-10 against walks that keep plain lists, and as streams over several micro-batches."""

from __future__ import annotations

import random
from collections import Counter
from math import hypot

import pytest

from gatewatch.streaming import folds, persons

SCHEMA = "camera_id long, id long, at double, track long, person_group long, x1 double, y1 double, x2 double, y2 double, hash string, plate string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
T0 = 1_790_000_000.0


def sightings(seed, n=900, cameras=2):
    r = random.Random(seed)
    looks = [r.getrandbits(64) for _ in range(12)]
    out, at = [], T0
    for i in range(n):
        at += r.choice([0.2, 1.0, 3.0, 60.0 if r.random() < 0.1 else 2.0, 500.0 if r.random() < 0.02 else 0.0])
        look = r.choice(looks)
        for _ in range(r.choice([0, 2, 5, 8, 9, 12])):
            look ^= 1 << r.randrange(64)
        x, y, w, h = r.randrange(500), r.randrange(300), r.choice([40, 60, 90]), r.choice([80, 120])
        out.append((r.randrange(cameras), i, round(at, 3), r.choice([None, -1, r.randrange(40), r.randrange(4000)]), r.choice([None, None, None, r.randrange(30)]), float(x), float(y), float(x + w), float(y + h), f"{look:016x}" if r.random() < 0.7 else None, r.choice([None, "A1", "B2", "C3", f"D{r.randrange(90)}"])))
    return out


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def plain_people(rows, keep=600):
    out = []
    for camera in {r[0] for r in rows}:
        known, seen_tracks, seen_looks, alias, gens = [], {}, [], {}, {}
        for r in sorted((dict(zip(NAMES, r)) for r in rows if r[0] == camera), key=lambda r: (r["at"], r["id"])):
            now, track, group = r["at"], -1 if r["track"] is None else r["track"], r["person_group"]
            cx, cy, area = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2, (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
            if group is not None:
                key = ("g", group)
            elif track >= 0:
                g, last = gens.get(track, (1, now))
                if now - last > keep:
                    g = 1
                elif now - last > 8:
                    g += 1
                gens[track] = (g, now)
                key = ("t", track, g)
            else:
                continue
            live = lambda k: next((m for m in known if m["key"] == k and now - m["last"] <= keep), None)  # noqa: B023, E731
            age = lambda m: now - m["last"]  # noqa: B023, E731
            ratio = lambda m: abs(area - m["area"]) / max(area, m["area"])  # noqa: B023, E731
            away = lambda m: hypot(cx - m["x"], cy - m["y"])  # noqa: B023, E731
            hd = lambda m: bits(r["hash"], m["hash"]) if r["hash"] and m["hash"] else None  # noqa: B023, E731
            verdict = None
            if group is not None and key in alias and live(alias[key]):
                verdict = ("A named", live(alias[key]), 0.0, 0)
            if verdict is None and group is not None:
                m = next((m for m in known if m["group"] == group and age(m) <= 120), None)
                verdict = m and ("A group", m, 0.0, 0)
            if verdict is None and track >= 0:
                m = next((m for m in known if track in m["tracks"] and age(m) <= 300), None)
                if m:
                    verdict = ("B track", m, 0.0, 0)
                elif track in seen_tracks and now - seen_tracks[track] < 300:
                    verdict = ("B seen", None, 0.0, 0)
                else:
                    seen_tracks[track] = now
            if verdict is None:
                near = []
                for i, m in enumerate(m for m in known if age(m) <= 120):
                    if away(m) <= 130 and ratio(m) <= 0.45 and hd(m) is not None and hd(m) <= 8:
                        near.append((away(m), i, "C look", m))
                    elif away(m) <= 60 and ratio(m) <= 0.35 and age(m) <= 20 and (hd(m) is None or hd(m) <= 10):
                        near.append((away(m), i, "C place", m))
                if near:
                    d, _, why, m = min(near, key=lambda x: x[:2])
                    verdict = (why, m, d, hd(m) or 0)
            if verdict is None and r["hash"]:
                m = next((m for m in known if age(m) <= 120 and hd(m) is not None and hd(m) <= 8 and ratio(m) <= 0.6), None)
                if m:
                    verdict = ("D look", m, away(m), hd(m))
                elif any(now - t <= 120 and bits(r["hash"], h) <= 8 for h, t in seen_looks):
                    verdict = ("D seen", None, 0.0, 0)
            if track >= 0:
                seen_tracks[track] = now
            state = {"x": cx, "y": cy, "area": area, "last": now}
            if verdict is None:
                if r["hash"]:
                    seen_looks.append((r["hash"], now))
                m = {"key": key, "id": r["id"], "group": group, "tracks": {track} - {-1}, "hash": r["hash"], **state}
                old = next((i for i, k in enumerate(known) if k["key"] == key and now - k["last"] <= keep), None)
                known = [k for k in known if k["key"] != key or now - k["last"] <= keep]
                if old is None:
                    alias = {a: k for a, k in alias.items() if k != key}  # they stood for one who is forgotten
                    known.append(m)
                else:
                    known[[k["key"] for k in known].index(key)] = m
                out.append((r["id"], r["id"], "E new"))
                continue
            why, m, _, _ = verdict
            if m is None:
                m = live(key)
            elif m["key"] != key:
                alias[key] = m["key"]
            if m is not None:
                m |= state | ({"hash": r["hash"]} if r["hash"] else {})
                m["tracks"] |= {track} - {-1}
            out.append((r["id"], m and m["id"], why))
    return sorted(out)


def plain_vehicles(rows):
    out = []
    for camera in {r[0] for r in rows}:
        texts, looks, places = {}, [], []
        for r in sorted((dict(zip(NAMES, r)) for r in rows if r[0] == camera), key=lambda r: (r["at"], r["id"])):
            now, why = r["at"], "new"
            if r["plate"]:
                if r["plate"] in texts and now - texts[r["plate"]] < 120:
                    why = "plate"
                else:
                    texts[r["plate"]] = now
            if why == "new" and r["hash"]:
                if any(now - t <= 60 and bits(h, r["hash"]) <= 3 for h, t in looks):
                    why = "look"
                else:
                    looks.append((r["hash"], now))
            if why == "new":
                cx, cy, area = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2, (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
                places = [p for p in places if now - p[3] < 30][-20:]
                if any(hypot(cx - x, cy - y) < 45 and abs(area - a) / max(area, a) < 0.4 for x, y, a, _ in places):
                    why = "place"
                else:
                    places.append((cx, cy, area, now))
            out.append((r["id"], why))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_people_against_a_walk(spark, seed):
    rows = sightings(seed)
    got = sorted((r["id"], r["event"], r["outcome"]) for r in persons.people(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == plain_people(rows)
    assert {x[2] for x in got} >= {"A group", "A named", "B track", "C look", "C place", "D look", "E new"}, Counter(x[2] for x in got)


def test_vehicles_against_a_walk(spark):
    rows = sightings(3)
    got = sorted((r["id"], r["outcome"]) for r in persons.vehicles(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == plain_vehicles(rows) and {x[1] for x in got} == {"new", "plate", "look", "place"}


@pytest.mark.parametrize("kind", ["people", "vehicles"])
def test_streams_over_six_micro_batches(spark, tmp_path, kind):
    rows = sightings(4, 400)
    step = -(-len(rows) // 6)
    for n in range(6):
        spark.createDataFrame(rows[n * step : (n + 1) * step], SCHEMA).selectExpr("*", "timestamp_micros(cast(at * 1000000 as long)) as created_at").coalesce(1).write.parquet(f"{tmp_path}/in/{n:02}")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/00").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("created_at", "1 second")
    with folds.rocksdb(spark):
        out = folds.run_available(getattr(persons, f"{kind}_stream")(stream), kind).collect()
    if kind == "people":
        assert sorted((r["id"], r["event"], r["outcome"]) for r in out) == plain_people(rows)
    else:
        assert sorted((r["id"], r["outcome"]) for r in out) == plain_vehicles(rows)


def test_the_index_finds_what_a_scan_finds():
    r = random.Random(5)
    for most in (0, 3, 8):
        index, entered = persons.HashIndex(most, 50), []
        for i in range(400):
            h = r.choice(entered)[0] if entered and r.random() < 0.6 else f"{r.getrandbits(64):016x}"
            for _ in range(r.randrange(most + 3)):
                h = f"{int(h, 16) ^ 1 << r.randrange(64):016x}"
            assert index.near(h, i) == any(i - t <= 50 and bits(h, x) <= most for x, t in entered)
            index.add(h, i)
            entered.append((h, i))
            if i % 40 == 0:
                index.forget(i)
        assert len(index.entries) < 400


def test_no_sightings(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert persons.people(none).count() == 0 and persons.vehicles(none).count() == 0
