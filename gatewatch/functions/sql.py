"""UD-2 to UD-6: functions for `spark.sql`, registered by `register(spark)`.

plate_check(text)                                     struct of original, corrected, valid, penalty, candidates
plate_status(text, confidence, quality)               1 readable, 2 to be reviewed, 0 failed
plate_segments(text)                                  struct of region, number, series of a well-formed plate, else null
box_zone(x1, y1, x2, y2, near, mid)                   NEAR, MID or FAR; zones are arrays of [x, y]
kept_boxes(TABLE(t) PARTITION BY frame ORDER BY (confidence DESC, box_id))      boxes whose centre is apart from every kept one's
one_to_one(TABLE(t) PARTITION BY frame ORDER BY (iou DESC, a_box_id, b_box_id)) pairs whose boxes no earlier pair took
plate_candidates(json)                                the candidates of a capture's metadata, the surest valid one marked

Scalars are Arrow-batched; a table function holds the kept boxes of one frame. In DataFrame code the column expressions in `plates`
and `geometry` do the same without Python."""

from __future__ import annotations

import json
from math import hypot

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import plate_text
from .geometry import ZONE_SHARES

CHECK = "original string, corrected string, valid boolean, penalty double, candidates array<string>"


def plate_check(text: pd.Series) -> pd.DataFrame:
    seen = {t: plate_text.correct(t) for t in text.unique()}  # a plate comes many times in a batch
    return pd.DataFrame([seen[t] for t in text], columns=["original", "corrected", "valid", "penalty", "candidates"])


def plate_status(text: pd.Series, confidence: pd.Series, quality: pd.Series) -> pd.Series:
    def one(t: str | None, c: float, q: float) -> int:
        if not (t or "").strip():
            return 0
        found = plate_text.correct(t)
        if not found["valid"]:
            return 2 if found["candidates"] else 0
        return 1 if c >= 0.70 and q >= 0.45 else 2

    return pd.Series([one(t, 0.0 if c != c or c is None else c, -1.0 if q != q or q is None else q) for t, c, q in zip(text, confidence, quality)])


def plate_segments(text: pd.Series) -> pd.DataFrame:
    import re

    def one(t: str | None) -> tuple:
        t = plate_text.normalized(t)
        return re.fullmatch("([A-Z]{1,2})([0-9]{1,4})([A-Z]{0,3})", t).groups() if plate_text.known(t) else (None, None, None)

    return pd.DataFrame([one(t) for t in text], columns=["region", "number", "series"])


def shoelace(p: list) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2


def clipped(p: list, box: tuple) -> list:
    """The part of a polygon inside a box."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(p, p[1:] + p[:1]):
            ins, nxt = (sign * (v[axis] - limit) >= 0 for v in (a, b))
            if ins:
                out.append(a)
            if ins != nxt:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                met = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                out.append((limit, met) if axis == 0 else (met, limit))
        p = out
    return p


def holds(p: list, x: float, y: float) -> bool:
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1])) % 2 == 1


def in_zone(box: tuple, zone) -> bool:
    if zone is None:
        return False
    zone = [tuple(q) for q in zone]
    if len(zone) < 3:
        return True
    own = max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1])
    part = clipped(zone, box) if own else []
    inside = shoelace(part) if len(part) > 2 else 0.0
    whole, x = shoelace(zone), (box[0] + box[2]) / 2
    middle = holds(zone, x, (box[1] + box[3]) / 2) or holds(zone, x, box[3])
    return bool(own and (inside / own >= ZONE_SHARES[0] or (whole and inside / whole >= ZONE_SHARES[1]) or (middle and inside / own >= ZONE_SHARES[2])))


def box_zone(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, near: pd.Series, mid: pd.Series) -> pd.Series:
    return pd.Series(["NEAR" if in_zone(b, n) else "MID" if in_zone(b, m) else "FAR" for *b, n, m in zip(x1, y1, x2, y2, near, mid)])


class KeptBoxes:
    """Rows of a frame (frame, box_id, confidence, x1, y1, x2, y2, in the order that counts): those with a centre 18 pixels apart at least."""

    def __init__(self) -> None:
        self.kept: list[tuple[float, float]] = []

    def eval(self, row: Row):
        x, y = (row["x1"] + row["x2"]) / 2, (row["y1"] + row["y2"]) / 2
        if all(hypot(x - a, y - b) >= 18.0 for a, b in self.kept):
            self.kept.append((x, y))
            yield row["frame"], row["box_id"]


class OneToOne:
    """Pairs of a frame (frame, a_box_id, b_box_id, in the order that counts): those whose boxes are both free yet."""

    def __init__(self) -> None:
        self.a, self.b = set(), set()

    def eval(self, row: Row):
        if row["a_box_id"] not in self.a and row["b_box_id"] not in self.b:
            self.a.add(row["a_box_id"])
            self.b.add(row["b_box_id"])
            yield row["frame"], row["a_box_id"], row["b_box_id"]


class PlateCandidates:
    """The candidates (text, confidence) in a capture's JSON; the surest valid one is marked best. Broken JSON has none."""

    def eval(self, text: str):
        try:
            found = json.loads(text or "{}").get("candidates") or []
            rows = [(c.get("text"), float(c.get("confidence") or 0.0)) for c in found if isinstance(c, dict)]
        except (ValueError, TypeError, AttributeError):
            return
        checked = [(t, c, plate_text.correct(t)) for t, c in rows]
        good = [(c, r["corrected"], i) for i, (_, c, r) in enumerate(checked) if r["valid"]]
        best = max(good)[2] if good else None
        for i, (t, c, r) in enumerate(checked):
            yield i, t, r["corrected"], c, r["valid"], i == best


def register(spark: SparkSession) -> None:
    spark.udf.register("plate_check", pandas_udf(plate_check, CHECK))
    spark.udf.register("plate_status", pandas_udf(plate_status, "int"))
    spark.udf.register("plate_segments", pandas_udf(plate_segments, "region string, number string, series string"))
    spark.udf.register("box_zone", pandas_udf(box_zone, "string"))
    spark.udtf.register("kept_boxes", udtf(KeptBoxes, returnType="frame long, box_id long"))
    spark.udtf.register("one_to_one", udtf(OneToOne, returnType="frame long, detection long, track long"))
    spark.udtf.register("plate_candidates", udtf(PlateCandidates, returnType="place int, text string, corrected string, confidence double, valid boolean, best boolean"))
