"""Event upserts: readings of one event are folded in order, and only better ones change what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plates as P

#: What a reading brings and what an event keeps.
READING = ["object_type", "number", "plate", "raw_text", "plate_status", "ocr", "consensus", "quality", "stable", "vehicle_confidence", "has_driver", "direction", "vehicle_type", "image", "face_confidence", "face_image"]
PLATE = ["number", "plate", "raw_text", "plate_status", "ocr", "consensus", "quality", "stable"]
EVENT_SCHEMA = (
    "event_key string, object_type string, plate string, raw_text string, plate_status int, ocr double, consensus double, quality double, stable boolean, vehicle_confidence double, "
    "has_driver boolean, direction string, vehicle_type string, image string, face_confidence double, face_image string, detection_confidence double, status int, n_readings long, n_changes long"
)


def score(r: dict) -> float:
    return 0.45 * r["ocr"] + 0.30 * r["consensus"] + 0.25 * r["quality"]


def better_plate(new: dict, old: dict) -> bool:
    """Whether a reading's plate, failed or not, replaces the stored one: stability first, then a margin that is wider for another plate."""
    if not new["number"]:
        return False
    if not old["plate"]:
        return True
    if new["stable"] is True and not old["stable"]:
        return True
    if new["number"] == old["plate"]:
        return score(new) > score(old) + 0.02 and not (old["stable"] is True and new["stable"] is False)
    return new["stable"] is True and old["stable"] is True and score(new) > score(old) + 0.08


def fold(stored: dict | None, new: dict) -> tuple[dict, bool]:
    """The stored event after a reading, and whether it changed."""
    person = new["object_type"] == "person"
    if stored is None:
        return (settle_person if person else settle)(dict(new)), True
    return fold_person(stored, new) if person else fold_vehicle(stored, new)


def fold_vehicle(stored: dict, new: dict) -> tuple[dict, bool]:
    seen = stored["vehicle_confidence"] or 0.0
    plate = better_plate(new, stored)
    driver = bool(new["has_driver"]) and not stored["has_driver"]
    way = new["direction"] in ("entry", "exit") and stored["direction"] not in ("entry", "exit")
    clearer = new["vehicle_confidence"] > seen + 0.05
    image = bool(new["image"]) and not stored["image"]
    first = bool(new["number"]) and not stored["number"]
    if not (plate or driver or way or image or first or clearer):
        return stored, False
    out = stored | {"object_type": "vehicle"}
    if plate or first:
        out |= {k: new[k] for k in PLATE}
    out["vehicle_confidence"] = max(seen, new["vehicle_confidence"])
    out["has_driver"] = bool(stored["has_driver"] or new["has_driver"])
    out["direction"] = new["direction"] if new["direction"] in ("entry", "exit") else stored["direction"]
    if image or (clearer and new["image"]):  # a picture gives way to a clearer one only
        out["image"] = new["image"]
    out["vehicle_type"] = new["vehicle_type"]
    return settle(out), True


def fold_person(stored: dict, new: dict) -> tuple[dict, bool]:
    """A person's event changes with a clearer face only, and only if the reading brings its picture."""
    face = new["face_confidence"]
    if face <= (stored["face_confidence"] or 0.0) + 0.05 or not new["face_image"]:
        return stored, False
    way = new["direction"] if new["direction"] in ("entry", "exit") else stored["direction"]
    out = stored | {"object_type": "person", "face_confidence": face, "face_image": new["face_image"], "direction": way}
    return out | {"detection_confidence": max(face, stored["detection_confidence"] or 0.0), "status": face_status(face)}, True


def face_status(confidence: float) -> int:
    return 1 if confidence >= 0.65 else 2 if confidence >= 0.40 else 0


def settle_person(event: dict) -> dict:
    """A new person's event: it keeps nothing of a vehicle."""
    event |= dict.fromkeys([*PLATE, "vehicle_confidence", "image"]) | {"has_driver": False}
    return event | {"detection_confidence": event["face_confidence"], "status": face_status(event["face_confidence"])}


def settle(event: dict) -> dict:
    """Confidence and status of a vehicle's event: its plate's, or by the vehicle's confidence."""
    if event["number"]:  # also of a plate that was seen but failed
        event["detection_confidence"], event["status"] = event["ocr"], event["plate_status"]
    else:
        c = event["detection_confidence"] = event["vehicle_confidence"]
        event["status"] = 1 if c >= 0.70 else 2 if c >= 0.40 else 0
    return event


def prepared(readings: DataFrame, *more: str) -> DataFrame:
    """Readings with values in range, the plate canonical, and no plate where it failed; `more` columns stay as they are.

    object_type (vehicle unless person), raw_text (the plate as read where null), face_confidence and face_image may be absent. A
    reading without plate characters has no number and no raw text."""
    given = lambda name, kind: F.col(name) if name in readings.columns else F.lit(None).cast(kind)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    vehicle = given("object_type", "string").eqNullSafe("person") == F.lit(False)
    number = F.when(vehicle & (F.col("_number") != ""), F.col("_number"))
    text = F.when(number.isNotNull(), F.coalesce(given("raw_text", "string"), "plate"))
    rows = readings.withColumn("plate_status", P.status(F.col("plate"), F.col("ocr"), F.col("quality"))).withColumn("_number", P.canonical(F.col("plate")))
    return rows.select(
        F.when(F.trim("event_key") != "", F.col("event_key")).alias("event_key"), "seq", F.when(vehicle, "vehicle").otherwise("person").alias("object_type"), number.alias("number"), text.alias("raw_text"), F.when(F.col("plate_status") > 0, F.col("_number")).alias("plate"), "plate_status",
        unit("ocr").alias("ocr"), unit("consensus").alias("consensus"), unit("quality").alias("quality"), "stable", unit("vehicle_confidence").alias("vehicle_confidence"), F.coalesce("has_driver", F.lit(False)).alias("has_driver"),
        F.when(F.col("direction").isin("entry", "exit"), F.col("direction")).otherwise("unknown").alias("direction"), F.coalesce("vehicle_type", F.lit("unknown")).alias("vehicle_type"), "image", F.when(~vehicle, unit(given("face_confidence", "double"))).alias("face_confidence"), F.when(~vehicle, given("face_image", "string")).alias("face_image"), *more,
    )


def merged_events(readings: DataFrame) -> DataFrame:
    """The stored event of each key after all its readings in order of seq. Acceptance depends on what was accepted before, so an
    event's readings are folded one by one, along sorted partitions. A reading without a key is an event of its own."""
    from ..streaming.folds import fold_batch, fold_each

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        stored, changed = fold(state and state["stored"], {k: row[k] for k in READING})
        return {"key": row["event_key"], "stored": stored, "n": (state["n"] if state else 0) + 1, "changes": (state["changes"] if state else 0) + changed}, []

    def final(state: dict) -> list[dict]:
        return [{"event_key": state["key"], **state["stored"], "n_readings": state["n"], "n_changes": state["changes"]}]

    rows = prepared(readings)
    keyed = fold_batch(rows.filter("event_key is not null"), ["event_key"], ["seq"], step, EVENT_SCHEMA, final)
    return keyed.unionByName(fold_each(rows.filter("event_key is null"), step, EVENT_SCHEMA, final))


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with the last change of each key (by seq) put in; columns that a change leaves null keep their value."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = [c for c in target.columns if c != key]
    last = changes.select(key, *[F.last(c, ignorenulls=True).over(w).alias(f"_{c}") for c in values]).dropDuplicates([key])
    joined = target.join(last, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in values])
