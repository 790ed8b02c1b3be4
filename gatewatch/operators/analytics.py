"""Summaries of de-duplicated events. All take the output of dedup.best_per_event, joined with plates and cameras where said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camera_status, dotted


def _n(condition: str | Column, name: str) -> Column:
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.count_if(condition), F.lit(0)).alias(name)


VEHICLE, PERSON = "object_type = 'vehicle'", "object_type = 'person'"


def counts() -> list[Column]:
    """Totals, entries and exits of vehicles and people, plates and distinct plates."""
    return [
        _n(VEHICLE, "vehicles"), _n(f"{VEHICLE} and direction = 'entry'", "vehicle_entry"), _n(f"{VEHICLE} and direction = 'exit'", "vehicle_exit"),
        _n(PERSON, "people"), _n(f"{PERSON} and direction = 'entry'", "person_entry"), _n(f"{PERSON} and direction = 'exit'", "person_exit"),
        _n("has_plate = 1", "plates"), F.count_distinct(F.when(F.col("plate_number") != "", F.col("plate_number"))).alias("unique_plates"),
    ]


def with_plates(events: DataFrame, plates: DataFrame) -> DataFrame:
    return events.join(plates.select("plate_id", "plate_number", "ocr_confidence", F.col("detection_status").alias("plate_status")), "plate_id", "left")


def summary(events: DataFrame) -> DataFrame:
    return events.agg(*counts())


def camera_totals(cameras: DataFrame) -> DataFrame:
    return cameras.agg(F.count("*").alias("cameras"), _n("status = 1", "active"))


def per_camera(events: DataFrame, cameras: DataFrame) -> DataFrame:
    """By camera: label, direction, status and counts."""
    joined = events.join(cameras.select("camera_id", "location", F.col("status").alias("on"), F.col("direction").alias("way")), "camera_id", "left")
    label = F.coalesce(F.max("source_name"), F.max("location"), F.concat(F.lit("CCTV-"), F.col("camera_id").cast("string")))
    return joined.groupBy("camera_id").agg(label.alias("camera"), F.max("way").alias("camera_direction"), camera_status(F.max("on")).alias("camera_status"), _n(VEHICLE, "vehicles"), _n(PERSON, "people"), _n("has_plate = 1", "plates"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("created_at").alias("day")).agg(*counts())


def hourly(events: DataFrame) -> DataFrame:
    """All 24 hours, with zeros where nothing happened."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    found = events.groupBy(F.hour("created_at").alias("hour")).agg(_n(VEHICLE, "vehicles"), _n(PERSON, "people"))
    dense = hours.join(F.broadcast(found), "hour", "left")  # 24 rows at most
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dense.select("hour", F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")).alias("label"), zero("vehicles"), zero("people"))


def vehicle_types(events: DataFrame) -> DataFrame:
    known = ["car", "motorcycle", "truck", "bus"]
    vehicles = events.filter(VEHICLE)
    other = F.col("vehicle_type").isNull() | ~F.col("vehicle_type").isin(known)
    return vehicles.agg(*[_n(F.col("vehicle_type") == k, k) for k in known], _n(other, "other"))


def plate_performance(events: DataFrame) -> DataFrame:
    """Readings by status, mean confidence of readable ones in percent, and the share of valid ones; null where there is none."""
    read = events.filter("plate_status is not null")
    status = lambda s, n: _n(F.col("plate_status") == s, n)
    rated = read.agg(F.count("*").alias("total"), status(1, "valid"), status(2, "to_check"), status(0, "failed"), F.avg(F.when(F.col("plate_status").isin(1, 2), F.col("ocr_confidence"))).alias("c"))
    return rated.select("total", "valid", "to_check", "failed", F.round(F.col("c") * 100, 1).alias("mean_confidence"), F.round(F.col("valid") * 100.0 / F.nullif("total", F.lit(0)), 1).alias("read_rate"))


def top_plates(events: DataFrame, n: int = 10) -> DataFrame:
    read = events.filter("plate_number is not null and plate_number <> ''")
    found = read.groupBy("plate_number").agg(F.count("*").alias("times"), F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"), F.max("created_at").alias("last_seen"), F.max("plate_status").alias("best_status"))
    return found.orderBy(F.desc("times"), F.desc("last_seen"), "plate_number").limit(n)


def peak_hour(hours: DataFrame) -> DataFrame:
    """The busiest hour, the first on ties, and what a reader is told of it."""
    best = hours.agg(F.max_by(F.struct("label", "vehicles"), F.struct("vehicles", (-F.col("hour")).alias("h"))).alias("b"))
    return best.select(F.col("b.label").alias("label"), F.col("b.vehicles").alias("vehicles"), F.concat(F.lit("Jam tersibuk "), F.col("b.label"), F.lit(" dengan "), dotted(F.col("b.vehicles")), F.lit(" kendaraan")).alias("insight"))


def camera_share(events: DataFrame) -> DataFrame:
    """Vehicles by camera and their share of all, in percent."""
    by = events.filter(VEHICLE).groupBy("camera_id").agg(F.count("*").alias("vehicles"))
    total = by.agg(F.sum("vehicles").alias("total"))
    return by.join(F.broadcast(total)).select("camera_id", "vehicles", F.round(F.col("vehicles") * 100.0 / F.col("total"), 1).alias("share"))  # one row


def trend(events: DataFrame, start: str, days: int) -> DataFrame:
    """A dense daily trend of `days` days from `start`."""
    all_days = events.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    found = events.groupBy(F.to_date("created_at").alias("day")).agg(_n(VEHICLE, "vehicles"), _n(PERSON, "people"))
    return all_days.join(found, "day", "left").select("day", F.date_format("day", "dd/MM").alias("label"), F.coalesce("vehicles", F.lit(0)).alias("vehicles"), F.coalesce("people", F.lit(0)).alias("people"))


def busiest_hours(hours: DataFrame, n: int = 3) -> DataFrame:
    total = hours.agg(F.sum("vehicles").alias("total"))
    share = F.round(F.col("vehicles") * 100.0 / F.nullif("total", F.lit(0)), 1)
    return hours.join(F.broadcast(total)).select("hour", "vehicles", share.alias("share")).orderBy(F.desc("vehicles"), "hour").limit(n)  # one row


def repeated_keys(detections: DataFrame) -> DataFrame:
    return detections.filter("event_key is not null").groupBy("event_key").agg(F.count("*").alias("rows")).filter("rows > 1")


def direction_share(events: DataFrame) -> DataFrame:
    both = events.filter(VEHICLE).agg(_n("direction = 'entry'", "entry"), _n("direction = 'exit'", "exit"))
    total = F.nullif(F.col("entry") + F.col("exit"), F.lit(0))
    return both.select("entry", "exit", F.round(F.col("entry") * 100.0 / total, 1).alias("entry_share"), F.round(F.col("exit") * 100.0 / total, 1).alias("exit_share"))


def availability(cameras: DataFrame) -> DataFrame:
    return camera_totals(cameras).select("cameras", "active", F.round(F.col("active") * 100.0 / F.nullif("cameras", F.lit(0)), 1).alias("availability"))


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts over event time."""
    w = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return events.groupBy(w.alias("w")).agg(_n(VEHICLE, "vehicles"), _n(PERSON, "people")).select(F.col("w.start").alias("start"), "vehicles", "people")


def running_totals(days: DataFrame) -> DataFrame:
    """Days are few: the running total needs them in one place, after the aggregation."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("day", "vehicles", F.sum("vehicles").over(w).alias("vehicles_so_far"))


def statistics(events: DataFrame, cameras: DataFrame, period: str = "all", as_of: str | None = None) -> DataFrame:
    """AG-11: all numbers of the statistics page, of events with plates, as rows (section, place, label, total, vehicles, plates, faces,
    percent, confidence, last_seen, status).

    One scan and one shuffle: grouping sets over nothing, day, hour, camera and plate. What follows works on their few rows, the
    plates being cut to the first ten in parts. Sections: kpi, status, availability, trend (hours of a day for `today`, 7 or 30 days up to
    as_of for `7d` and `30d`, the first 30 days otherwise), camera, peak (three hours), plate (ten)."""
    from ..plans.lineage import cut

    spark, days = events.sparkSession, {"today": 1, "7d": 7, "30d": 30}.get(period)
    rows = events.filter(F.to_date("created_at") >= F.date_sub(F.lit(as_of).cast("date"), days - 1)) if days else events
    located = rows.join(cameras.select("camera_id", "location"), "camera_id", "left")
    keyed = located.select(
        F.to_date("created_at").alias("day"), F.hour("created_at").alias("hour"), "camera_id", F.coalesce("source_name", "location", F.lit("CCTV")).alias("camera"), F.nullif("plate_number", F.lit("")).alias("plate"),
        "object_type", "has_plate", "detection_status", "detection_confidence", "ocr_confidence", "plate_status", "created_at", F.coalesce("location", F.lit("CCTV")).alias("location"),
    )
    sets = [[], [F.col("day")], [F.col("hour")], [F.col("camera_id"), F.col("camera")], [F.col("plate")]]
    counted = keyed.groupingSets(sets, "day", "hour", "camera_id", "camera", "plate").agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"), _n(VEHICLE, "vehicles"), _n(f"{VEHICLE} and has_plate = 1", "plates"), _n(PERSON, "faces"), *[_n(F.col("detection_status") == s, f"s{s}") for s in (0, 1, 2)],
        F.avg("detection_confidence").alias("sure"), F.avg("ocr_confidence").alias("read"), F.max("created_at").alias("last"), F.max("plate_status").alias("best"), F.max("location").alias("last_camera"),
    )
    found = cut(counted.filter("g <> 30 or plate is not null"))
    part = {name: found.filter(F.col("g") == g) for name, g in (("all", 31), ("day", 15), ("hour", 23), ("camera", 25), ("plate", 30))}
    whole = F.broadcast(part["all"].select(F.greatest("total", F.lit(1)).alias("of")))  # one row
    share = F.round(F.col("total") * 100.0 / F.col("of"), 1)
    none, dense = F.lit(None), F.coalesce(F.col("total"), F.lit(0))

    def in_percent(mean: str, default: float) -> Column:  # in decimals, so that what lies between two tenths goes up
        return F.round(F.coalesce(F.col(mean), F.lit(default)).cast("decimal(20,10)") * 100, 1)

    def section(df: DataFrame, name: str, place: Column, label: Column, total: Column | str = "total", counts: bool = True, percent: Column = none, confidence: Column = none, last: Column = none, status: Column = none) -> DataFrame:
        numbers = [(F.coalesce(F.col(c), F.lit(0)) if counts else none).cast("long").alias(c) for c in ("vehicles", "plates", "faces")]
        total = F.col(total) if isinstance(total, str) else total
        return df.select(F.lit(name).alias("section"), place.cast("int").alias("place"), label.alias("label"), total.cast("long").alias("total"), *numbers, percent.cast("double").alias("percent"), confidence.cast("double").alias("confidence"), last.cast("string").alias("last_seen"), status.cast("string").alias("status"))

    def first(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
        ranked = df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        return ranked.filter(F.col("place") <= n) if n else ranked

    read_rate = F.when(F.col("vehicles") > 0, F.round(F.col("plates") * 100.0 / F.col("vehicles"), 1)).otherwise(0.0)
    kpi = section(part["all"], "kpi", F.lit(1), F.lit("all"), percent=read_rate, confidence=in_percent("sure", 0.85))
    states = part["all"].select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("c")) for n, c in (("valid", "s1"), ("warning", "s2"), ("failed", "s0"))])).alias("i", "s"))
    status = section(states, "status", F.col("i") + 1, F.col("s.n"), F.col("s.c"), False)
    active = availability(cameras)
    on = section(active, "availability", F.lit(1), F.lit("active"), "active", False, F.coalesce("availability", F.lit(0.0)))
    if period == "today":
        slots = spark.range(24).select(F.col("id").cast("int").alias("hour")).join(part["hour"].drop("day"), "hour", "left")
        trend_ = section(slots, "trend", F.col("hour") + 1, F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")), dense)
    elif days:
        slots = spark.range(days).select(F.date_sub(F.lit(as_of).cast("date"), F.lit(days - 1) - F.col("id").cast("int")).alias("day"), (F.col("id") + 1).alias("place")).join(part["day"], "day", "left")
        trend_ = section(slots, "trend", F.col("place"), F.date_format("day", "dd/MM"), dense)
    else:
        trend_ = section(first(part["day"], 30, F.asc("day")), "trend", F.col("place"), F.date_format("day", "dd/MM"))
    by_camera = section(first(part["camera"], None, F.desc("total"), F.asc("camera_id"), F.asc("camera")).join(whole), "camera", F.col("place"), F.col("camera"), percent=share)
    hour_label = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00 - "), F.lpad((F.col("hour") + 1).cast("string"), 2, "0"), F.lit(":00 WIB"))
    peak = section(first(part["hour"], 3, F.desc("total"), F.asc("hour")).join(whole), "peak", F.col("place"), hour_label, counts=False, percent=share)
    seen = first(part["plate"], 10, F.desc("total"), F.desc("last"), F.asc("plate"))
    known = F.when(F.col("best") == 1, "Terbaca").when(F.col("best") == 2, "Perlu cek").otherwise("Gagal")
    plates = section(seen, "plate", F.col("place"), F.col("plate"), counts=False, confidence=in_percent("read", 0.8), last=F.concat_ws(" @ ", F.date_format("last", "yyyy-MM-dd HH:mm"), "last_camera"), status=known)
    out = kpi
    for more in (status, on, trend_, by_camera, peak, plates):
        out = out.unionByName(more)
    return out
