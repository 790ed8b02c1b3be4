"""SS-5 to SS-8: plates followed over a camera's frames, read now and then, voted on, and given out when they are gone.

A box joins a track by its vehicle's group, else by the vehicle's track number, else by overlap; generation and group, where both know
theirs, must agree. A track keeps its best crop since it was read last; every `every` matches that crop is read, `attempts` times at
most, until the vote over the readings so far is stable. A track that nothing has joined for more than `gap` seconds is finished:
it is given out if it has readings.

`PlateTracks` is the tracker of one camera. The batch twin walks sorted partitions with it; the stream keeps its tracks and readings in
list states, and event-time timers finish tracks of cameras where nothing comes any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plate_text
from ..functions import plates as P
from .walks import Walk, names_of, walk_batch, walk_stream

#: What the tracker reads of a box; text and ocr are what reading its crop gives.
BOX = ["camera_id", "frame", "id", "at", "x1", "y1", "x2", "y2", "confidence", "vehicle", "vehicle_group", "generation", "quality", "text", "ocr"]
TRACK = (
    "track long, vehicle long, vehicle_group long, generation long, x1 double, y1 double, x2 double, y2 double, confidence double, first_at double, last_at double, matches int, attempts int, stable boolean, "
    "crop_quality double, crop_text string, crop_valid boolean, crop_penalty double, crop_ocr double"
)
READING = "track long, text string, confidence double, quality double, valid boolean"
FINISHED = (
    "camera_id long, track long, vehicle long, vehicle_group long, generation long, first_at double, last_at double, text string, exact int, reads int, confidence double, best_confidence double, "
    "consensus double, quality double, detection_confidence double, valid boolean, stable boolean"
)
_TRACK, _READING = names_of(TRACK), names_of(READING)


def vote(readings: list[dict]) -> dict | None:
    """The vote over readings (text, confidence, quality) in the order that they came; as operators.votes.votes, for a track's few."""
    groups: dict[int, list[tuple[dict, float]]] = {}
    for r in readings:
        if r["text"]:
            groups.setdefault(len(r["text"]), []).append((r, max(0.05, r["confidence"]) * (0.5 + 0.5 * r["quality"])))
    best = None
    for group in groups.values():
        total, chars, shares = sum(w for _, w in group), [], []
        for at in range(len(group[0][0]["text"])):
            found: dict[str, list[float]] = {}
            for r, w in group:
                weight = found.setdefault(r["text"][at], [0.0, 0.0])
                weight[0], weight[1] = weight[0] + w, max(weight[1], r["confidence"])
            char = max(found, key=found.get)
            chars.append(char)
            shares.append(found[char][0] / total)
        text = "".join(chars)
        valid = plate_text.valid(text)
        rank = total * (1.08 if valid else 1.0), valid
        if best is None or rank > best[0]:
            best = rank, text, sum(shares) / len(shares), valid, group
    if best is None:
        return None
    _, text, consensus, valid, group = best
    agree = [(r, w, sum(a == b for a, b in zip(r["text"], text)) / len(text)) for r, w in group]
    support = [x for x in agree if x[2] >= 0.75] or [(r, w, 1.0) for r, w in group]
    confidence = consensus * sum(r["confidence"] * w * a for r, w, a in support) / (sum(w for _, w, _ in support) or 1.0)
    top = max(support, key=lambda x: (x[2], 0.55 * x[0]["quality"] + 0.45 * x[0]["confidence"]))[0]
    exact = sum(r["text"] == text for r, _ in group)
    stable = valid and len(group) >= 2 and consensus >= 0.70 and confidence >= 0.65 and (exact >= 2 or consensus >= 0.85)
    return {"text": text, "exact": exact, "reads": len(readings), "confidence": confidence, "best_confidence": top["confidence"], "consensus": consensus, "quality": top["quality"], "valid": valid, "stable": stable}


def iou(a: dict, b: dict) -> float:
    w, h = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])), max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return w * h / union if w * h and union > 0 else 0.0


def differ(a: object, b: object) -> bool:
    """Whether both are known and not the same."""
    return a is not None and b is not None and a != b


class PlateTracks(Walk):
    """The plates of one camera."""

    STATES = {"tracks": TRACK, "readings": READING, "counter": "camera long, next long"}

    def __init__(self, gap: float = 1.0, overlap: float = 0.3, every: int = 3, attempts: int = 5, least: float = 0.20, least_ocr: float = 0.45, width: float = 30, height: float = 10) -> None:
        self.gap, self.overlap, self.every, self.attempts, self.least, self.least_ocr, self.width, self.height = gap, overlap, every, attempts, least, least_ocr, width, height
        self.camera, self.next, self.tracks, self.readings = None, 1, [], {}

    def expired(self, at: float) -> list[dict]:
        """Finishes what nothing has joined for more than the gap."""
        gone = [t for t in self.tracks if at - t["last_at"] > self.gap]
        self.tracks = [t for t in self.tracks if at - t["last_at"] <= self.gap]
        return [f for t in gone if (f := self.finished(t))]

    def due(self) -> float | None:
        return min(t["last_at"] for t in self.tracks) + self.gap if self.tracks else None

    def dump(self) -> dict[str, list[tuple]]:
        readings = [r for found in self.readings.values() for r in found]
        return {"tracks": [tuple(t[n] for n in _TRACK) for t in self.tracks], "readings": [tuple(r[n] for n in _READING) for r in readings], "counter": [(self.camera, self.next)]}

    def load(self, tables: dict[str, list[tuple]]) -> None:
        self.tracks = [dict(zip(_TRACK, t, strict=True)) for t in tables["tracks"]]
        for r in tables["readings"]:
            self.readings.setdefault(r[0], []).append(dict(zip(_READING, r, strict=True)))
        if tables["counter"]:
            self.camera, self.next = tables["counter"][0]

    def finished(self, t: dict) -> dict | None:
        won = vote(self.readings.pop(t["track"], []))
        return won and {"camera_id": self.camera, **{k: t[k] for k in ("track", "vehicle", "vehicle_group", "generation", "first_at", "last_at")}, "detection_confidence": t["confidence"], **won}

    def found(self, box: dict) -> dict | None:
        """The box's track: by group or vehicle, the oldest first; else by overlap, the greatest first."""
        open_ = [t for t in self.tracks if not differ(t["generation"], box["generation"])]
        for t in open_:
            if box["vehicle_group"] is not None and t["vehicle_group"] is not None:
                if box["vehicle_group"] == t["vehicle_group"]:
                    return t
            elif box["vehicle"] is not None and box["vehicle"] >= 0 and t["vehicle"] == box["vehicle"]:
                return t
        near = [(iou(t, box), t) for t in open_ if not differ(t["vehicle_group"], box["vehicle_group"])]
        best = max(near, key=lambda x: x[0], default=(0.0, None))
        return best[1] if best[0] >= self.overlap else None

    def take(self, box: dict) -> list[dict]:
        """A box in order of time; the tracks that are finished by then come out."""
        self.camera = box["camera_id"]
        out = self.expired(box["at"])
        if box["confidence"] < self.least:
            return out
        t = self.found(box)
        if t is None:
            t = dict.fromkeys(_TRACK) | {"track": self.next, "confidence": box["confidence"], "first_at": box["at"], "matches": min(1, self.every), "attempts": 0, "stable": False, "crop_quality": -1.0, "generation": 1 if box["generation"] is None else box["generation"], "vehicle": box["vehicle"], "vehicle_group": box["vehicle_group"]}
            self.next += 1
            self.tracks.append(t)
        else:
            t["matches"] += 1
            t["confidence"] = max(t["confidence"], box["confidence"])
            t |= {k: box[k] for k in ("vehicle", "vehicle_group", "generation") if box[k] is not None}
        t |= {k: box[k] for k in ("x1", "y1", "x2", "y2")} | {"last_at": box["at"]}
        if box["x2"] - box["x1"] >= self.width and box["y2"] - box["y1"] >= self.height and box["quality"] >= t["crop_quality"]:
            t |= {"crop_quality": box["quality"], "crop_text": box["corrected"], "crop_valid": box["valid"], "crop_penalty": box["penalty"], "crop_ocr": box["ocr"]}
        if not t["stable"] and t["attempts"] < self.attempts and t["matches"] >= self.every and t["crop_quality"] >= 0:
            self.read(t)
        return out

    def read(self, t: dict) -> None:
        """Reads the best crop since the last time: a reading counts if it is sure enough, a malformed one only from 0.55 on."""
        text, ocr, quality = t["crop_text"], t["crop_ocr"] or 0.0, t["crop_quality"]
        t |= {"matches": 0, "attempts": t["attempts"] + 1, "crop_quality": -1.0}
        if not text or ocr < self.least_ocr or (not t["crop_valid"] and ocr < 0.55):
            return
        confidence = max(0.0, min(1.0, ocr * (1.0 - t["crop_penalty"] * 0.5)))
        readings = self.readings.setdefault(t["track"], [])
        readings.append({"track": t["track"], "text": text, "confidence": confidence, "quality": max(0.0, min(1.0, quality)), "valid": t["crop_valid"]})
        t["stable"] = vote(readings)["stable"]


def prepared(boxes: DataFrame, *more: str) -> DataFrame:
    """Boxes with what reading their crop gives, corrected by column expressions. Nulls: no confidence and no quality are 0."""
    read: Column = P.correct(F.col("text"))
    filled = boxes.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "quality": F.coalesce("quality", F.lit(0.0)), "_read": read})
    return filled.select(*BOX, F.col("_read.corrected").alias("corrected"), F.col("_read.valid").alias("valid"), F.col("_read.penalty").alias("penalty"), *more)


def tracked(boxes: DataFrame, **limits: float) -> DataFrame:
    """The finished plates of all cameras; at the end of the table every track is finished."""
    return walk_batch(prepared(boxes), ["camera_id"], ["at", "frame", "id"], lambda: PlateTracks(**limits), FINISHED)


def tracked_stream(boxes: DataFrame, **limits: float) -> DataFrame:
    """The same over a stream with a watermark on created_at, from which `at` comes: a plate is given out by the next box of its
    camera, or once the watermark has passed its last box by the gap. Needs the RocksDB state store."""
    return walk_stream(prepared(boxes, "created_at"), ["camera_id"], ["at", "frame", "id"], lambda: PlateTracks(**limits), FINISHED)
