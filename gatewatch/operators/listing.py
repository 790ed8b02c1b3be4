"""Filters, pages and listings."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plates as P
from ..functions.text import contains, percent, status_label

#: Days before the as-of date where a period starts.
PERIODS = {"today": 0, "yesterday": 1, "2d": 1, "7d": 6, "30d": 29}


def period(name: str, as_of: date, start: date | None = None, end: date | None = None) -> tuple[str, date | None, date | None]:
    """Label, first and last day; given dates win, an unknown name without them is custom and open."""
    if start or end:
        return "custom", start, end
    if name == "all":
        return name, None, None
    if name not in PERIODS:
        return "custom", None, None
    first = as_of - timedelta(days=PERIODS[name])
    return name, first, first if name == "yesterday" else as_of


def conditions(start: date | None = None, end: date | None = None, camera_id: int | None = None, region: str | None = None, gate: str | None = None, direction: str | None = None, object_type: str | None = None, status: int | None = None) -> Column:
    """One predicate of all that is asked for; whole days, the last one included."""
    found = [F.lit(True)]
    if start:
        found.append(F.col("created_at") >= F.lit(str(start)).cast("timestamp"))
    if end:
        found.append(F.col("created_at") < F.lit(str(end + timedelta(days=1))).cast("timestamp"))
    for name, value in (("camera_id", camera_id), ("direction", direction), ("object_type", object_type), ("detection_status", status)):
        if value is not None and value != "all":
            found.append(F.col(name) == value)
    found += [contains(F.col("location"), x) for x in (region, gate) if x]
    return reduce(lambda a, b: a & b, found)


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """A page of the rows in a total order."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("total_pages"))


def readable(rows: DataFrame) -> DataFrame:
    """Detections that count as read: with a plate, a valid and sure one; without, by their own status."""
    plate_ok = F.col("plate_number").isNotNull() & (F.col("ocr_confidence") > 0) & P.is_valid(F.col("plate_number"))
    return rows.filter((F.col("detection_status") == 1) & F.when(F.col("has_plate") == 1, F.coalesce(plate_ok, F.lit(False))).otherwise(True))


def shaped(rows: DataFrame) -> DataFrame:
    """Listing columns: what was seen, a label of its status, and its confidence in percent."""
    kind = F.when(F.col("object_type") == "person", "person").when(F.col("has_plate") == 1, "plate").otherwise("vehicle")
    confidence = F.coalesce(F.nullif("ocr_confidence", F.lit(0.0)), F.nullif("detection_confidence", F.lit(0.0)), F.lit(0.0))
    return rows.select("detection_id", kind.alias("type"), F.col("camera_name"), status_label(F.col("detection_status"), "Perlu cek").alias("status"), percent(confidence).alias("confidence"), "created_at")


def revalidated(plates: DataFrame) -> DataFrame:
    """Plate history with the status judged anew; a failed plate is shown as `-`, its raw text stays."""
    status = P.status(F.col("plate_number"), F.col("ocr_confidence"), F.col("plate_crop_quality"))
    rows = plates.withColumn("code", status)
    return rows.select("plate_id", F.when(F.col("code") == 0, "-").otherwise(F.col("plate_number")).alias("shown"), "code", F.col("plate_number").alias("raw"))


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a | b, [contains(F.col(c), text) for c in columns]))


def work_queue(detections: DataFrame, most_retries: int = 3, limit: int = 10) -> DataFrame:
    """Vehicles with an image and no plate that may be tried again, newest first."""
    open_ = detections.filter((F.col("object_type") == "vehicle") & (F.col("has_plate") == 0) & F.col("image").isNotNull() & (F.coalesce("retries", F.lit(0)) < most_retries))
    return open_.orderBy(F.desc("created_at"), F.desc("detection_id")).limit(limit)


def round_robin(rows: DataFrame, cursor: int, n: int) -> DataFrame:
    """n rows of each frame from the cursor on, in a circle."""
    w = Window.partitionBy("frame")
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy("box_id")) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.pmod(F.col("_r") - cursor, F.col("_n")) < n).drop("_r", "_n")


def text_lines(items: DataFrame, height: float = 12.0) -> DataFrame:
    """Text of each group with items in lines from top to bottom and, within a line, from left to right."""
    w = Window.partitionBy("group_id").orderBy("y", "x")
    line = F.sum(F.when(F.col("y") - F.lag("y").over(w) > height, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    words = F.sort_array(F.collect_list(F.struct("line", "x", "text")))
    return items.withColumn("line", line).groupBy("group_id").agg(F.array_join(F.transform(words, lambda s: s["text"]), " ").alias("text"))


def admitted(boxes: DataFrame, min_width: float, min_height: float, low: float, high: float, least: float = 0.0) -> DataFrame:
    """Boxes large enough, of a fitting aspect and confidence."""
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.filter((width >= min_width) & (height >= min_height) & (width / F.greatest(height, F.lit(1e-9))).between(low, high) & (F.col("confidence") >= least))
