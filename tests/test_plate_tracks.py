"""The plate tracker against a plain one that keeps whole frames, its votes and validity against the column forms, and the stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import plates as P
from gatewatch.operators import votes
from gatewatch.streaming import folds
from gatewatch.streaming import plate_tracks as K

SCHEMA = "camera_id long, frame long, id long, at double, x1 double, y1 double, x2 double, y2 double, confidence double, vehicle long, vehicle_group long, generation long, quality double, text string, ocr double"
T0 = datetime(2026, 10, 22, 10, tzinfo=timezone.utc).timestamp()


def noisy(r):
    return "".join(r.choice(x) for x in ("B8DA1", "1OI0BZ", "2ZL3", "34S", "C0G", "D6"))[: r.randrange(3, 7)]


def boxes(seed, frames=400, cameras=2):
    r = random.Random(seed)
    out, i, at = [], 0, T0
    for frame in range(frames):
        at += r.choice([0.04, 0.04, 0.2, 1.5 if r.random() < 0.1 else 0.1])
        for camera in range(cameras):
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                lane = r.randrange(3)
                x, y = lane * 80 + r.randrange(12), lane * 30 + r.randrange(5)
                out.append((camera, frame, i, round(at, 3), float(x), float(y), float(x + r.choice([20, 60])), float(y + 20), r.choice([0.1, 0.3, 0.6, 0.9]), r.choice([None, lane, -1]), r.choice([None, None, lane]), r.choice([None, 1, 1, 2]), r.random(), r.choice(["B 1234 CD"] * 5 + ["B1Z34CD", noisy(r), None, ""]), r.choice([0.4, 0.5, 0.6, 0.9, 0.95, 0.97])))
                i += 1
    return out


def plain(rows, gap, names):
    """Frame by frame: what has been gone too long, then the frame's boxes in order."""
    done = []
    for camera in sorted({r[0] for r in rows}):
        live, number = [], 0
        mine = [dict(zip(names, r)) for r in rows if r[0] == camera]

        def end(now):
            for t in [t for t in live if now - t["seen"] > gap]:  # noqa: B023
                live.remove(t)  # noqa: B023
                if won := K.vote(t["reads"]):
                    done.append((camera, t["no"], t["first"], t["seen"], won["text"], won["reads"], won["exact"], round(won["confidence"], 9), t["best"], won["stable"]))  # noqa: B023

        for frame in sorted({(m["at"], m["frame"]) for m in mine}):
            end(frame[0])
            for m in sorted((m for m in mine if (m["at"], m["frame"]) == frame), key=lambda m: m["id"]):
                if m["confidence"] < 0.2:
                    continue
                hit, ov = None, 0.0
                same = lambda t, k: t[k] is None or m[k] is None or t[k] == m[k]  # noqa: B023, E731
                if m["vehicle_group"] is not None or (m["vehicle"] or -1) >= 0 or m["vehicle"] == 0:
                    for t in live:
                        if not same(t, "generation"):
                            continue
                        if m["vehicle_group"] is not None and t["vehicle_group"] is not None:
                            if t["vehicle_group"] == m["vehicle_group"]:
                                hit = t
                                break
                            continue
                        if m["vehicle"] is not None and m["vehicle"] >= 0 and t["vehicle"] == m["vehicle"]:
                            hit = t
                            break
                if hit is None:
                    for t in live:
                        if same(t, "generation") and same(t, "vehicle_group"):
                            a, b = t["box"], (m["x1"], m["y1"], m["x2"], m["y2"])
                            inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                            share = inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)
                            if share > ov:
                                hit, ov = t, share
                    hit = hit if ov >= 0.3 else None
                if hit is None:
                    number += 1
                    hit = {"no": number, "first": m["at"], "since": 1, "tries": 0, "reads": [], "crop": None, "best": m["confidence"], "stable": False, "vehicle": m["vehicle"], "vehicle_group": m["vehicle_group"], "generation": m["generation"] or 1}
                    live.append(hit)
                else:
                    hit["since"] += 1
                    hit["best"] = max(hit["best"], m["confidence"])
                    for k in ("vehicle", "vehicle_group", "generation"):
                        hit[k] = hit[k] if m[k] is None else m[k]
                hit |= {"box": (m["x1"], m["y1"], m["x2"], m["y2"]), "seen": m["at"]}
                if m["x2"] - m["x1"] >= 30 and m["y2"] - m["y1"] >= 10 and (hit["crop"] is None or m["quality"] >= hit["crop"]["quality"]):
                    hit["crop"] = m
                if not hit["stable"] and hit["tries"] < 5 and hit["since"] >= 3 and hit["crop"]:
                    crop, hit["crop"] = hit["crop"], None
                    hit["since"], hit["tries"] = 0, hit["tries"] + 1
                    if crop["corrected"] and crop["ocr"] >= 0.45 and (crop["valid"] or crop["ocr"] >= 0.55):
                        hit["reads"].append({"text": crop["corrected"], "confidence": crop["ocr"] * (1 - crop["penalty"] * 0.5), "quality": crop["quality"]})
                        hit["stable"] = K.vote(hit["reads"])["stable"]
        end(float("inf"))
    return sorted(done)


def told(rows):
    return sorted((r["camera_id"], r["track"], r["first_at"], r["last_at"], r["text"], r["reads"], r["exact"], round(r["confidence"], 9), r["detection_confidence"], r["stable"]) for r in rows)


@pytest.fixture(scope="module")
def corrected(spark):
    """What plates.correct makes of each text of the boxes."""

    def look(rows):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        texts = spark.createDataFrame([(t,) for t in {r[names.index("text")] for r in rows}], "text string").select("text", P.correct(F.col("text")).alias("c")).collect()
        return {r["text"]: (r["c"]["corrected"], r["c"]["valid"], r["c"]["penalty"]) for r in texts}

    return look


def test_votes_are_those_of_the_operator(spark):
    r = random.Random(2)
    rows = [(k, i, noisy(r), r.randrange(100) / 100, r.randrange(100) / 100) for k in range(60) for i in range(r.randrange(1, 6))]
    df = spark.createDataFrame([(k, k * 100 + i, t, c, q) for k, i, t, c, q in rows], "track_id long, reading_id long, text string, confidence double, crop_quality double")
    got = {x["track_id"]: x for x in votes.votes(df).collect()}
    for k in range(60):
        mine = K.vote([{"text": t, "confidence": c, "quality": q} for kk, _, t, c, q in rows if kk == k])
        assert (got[k]["text"], got[k]["exact"], got[k]["total"], got[k]["valid"], got[k]["stable"]) == (mine["text"], mine["exact"], mine["reads"], mine["valid"], mine["stable"])
        assert got[k]["consensus"] == pytest.approx(mine["consensus"]) and got[k]["confidence"] == pytest.approx(mine["confidence"])
    assert K.vote([]) is None


@pytest.mark.parametrize("seed", [3, 4])
def test_batch_against_a_plain_tracker(spark, corrected, seed):
    rows = boxes(seed)
    want = plain_of(rows, corrected, 1.0)
    got = told(K.tracked(spark.createDataFrame(rows, SCHEMA).repartition(3), gap=1.0).collect())
    assert got == want and len(want) > 40 and any(w[-1] for w in want)


def plain_of(rows, look, gap):
    found = look(rows)
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["corrected", "valid", "penalty"]
    return plain([(*r, *found[r[names.index("text")]]) for r in rows], gap, names)


def test_stream_over_ten_micro_batches(spark, corrected, tmp_path):
    """All that the last watermark has passed comes out, the same as in batch; a camera that falls silent is finished by its timer."""
    rows = [r for r in boxes(5, frames=300) if not (r[0] == 1 and r[1] > 150)]
    rows.append((0, 10_000, 10**6, T0 + 900.0, *rows[-1][4:]))  # long after, so that the watermark passes everything else
    step = -(-len(rows) // 10)
    for n in range(10):
        part = spark.createDataFrame(rows[n * step : (n + 1) * step], SCHEMA).selectExpr("*", "timestamp_micros(cast(at * 1000000 as long)) as created_at")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n:02}")
    schema = spark.read.parquet(f"{tmp_path}/in/00").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("created_at", "1 second")
    with folds.rocksdb(spark):
        out = folds.run_available(K.tracked_stream(stream, gap=1.0), "tracked")
    want = [w for w in plain_of(rows, corrected, 1.0) if w[3] < T0 + 800]
    assert told(out.collect()) == want and {w[0] for w in want} == {0, 1}


def test_odd_boxes(spark):
    rows = [(0, 1, 1, T0, 0.0, 0.0, 50.0, 20.0, None, None, None, None, None, None, None), (0, 2, 2, T0, 0.0, 0.0, 0.0, 0.0, 0.9, 1, 1, 1, 0.5, "B1234CD", 0.9)]
    assert K.tracked(spark.createDataFrame(rows, SCHEMA)).count() == 0 and K.tracked(spark.createDataFrame([], SCHEMA)).count() == 0
