"""The logical tables of the engine, derived from the driver's events, nation and orders tables.

Every adapter is a list of SQL expressions that Spark and DuckDB read alike; `cte` gives the same tables to an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = {
    "event_id": "event_id", "ts": "cast(ts as timestamp)", "user_id": "user_id", "event_type": "event_type",
    "k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)", "c": "cast(round(value * 100) as bigint) % 1000",
}
DETECTIONS = {
    "detection_id": "event_id", "plate_id": "case when k % 4 <> 3 and event_type <> 'error' then event_id end",
    "camera_id": "user_id % 30", "track_id": "cast(k as bigint)", "object_type": "case when event_type = 'error' then 'person' else 'vehicle' end",
    "vehicle_type": "case event_type when 'click' then 'car' when 'view' then 'motorcycle' when 'purchase' then 'truck' else 'unknown' end",
    "direction": "case k % 3 when 0 then 'entry' when 1 then 'exit' else 'unknown' end",
    "has_plate": "case when k % 4 <> 3 and event_type <> 'error' then 1 else 0 end", "detection_confidence": "cast(c as double) / cast(1000 as double)",
    "detection_status": "case when c >= 700 then 1 when c >= 400 then 2 else 0 end",
    "event_key": "case k % 10 when 0 then null when 1 then '  ' else concat('vehicle:', cast(user_id % 30 as varchar(20)), ':', cast(k as varchar(20))) end",
    "source_name": "case when k % 7 = 0 then concat('Video: ', event_type) end", "created_at": "ts",
}
PLATES = {
    "plate_id": "event_id", "plate_number": "concat(case k % 4 when 0 then 'B' when 1 then 'D' else 'AB' end, cast((user_id * 13 + k) % 900 + 1 as varchar(20)), 'CD')",
    "detection_status": "case when c >= 700 then 1 when c >= 300 then 2 else 0 end", "ocr_confidence": "cast(c as double) / cast(1000 as double)",
    "plate_crop_quality": "cast((c * 7) % 1000 as double) / cast(1000 as double)", "created_at": "ts",
}
CAMERAS = {
    "camera_id": "n_nationkey", "location": "concat(n_name, case n_regionkey % 3 when 0 then ' MASUK' when 1 then ' KELUAR' else '' end)",
    "status": "case when n_regionkey = 4 then 0 else 1 end", "direction": "case n_regionkey % 3 when 0 then 'entry' when 1 then 'exit' else 'unknown' end",
}
#: Boxes of a frame in pixels: every third is a plate, the others vehicles.
BOXES = {
    "box_id": "event_id", "frame": "cast(floor(event_id / 12) as bigint)", "kind": "case when event_id % 3 = 0 then 'plate' else 'vehicle' end", "confidence": "cast(c as double) / cast(1000 as double)",
    "x1": "cast((event_id * 37) % 500 as double)", "y1": "cast((event_id * 53) % 300 as double)",
    "x2": "cast((event_id * 37) % 500 + case when event_id % 3 = 0 then 20 + k % 40 else 80 + (k * 7) % 220 end as double)",
    "y2": "cast((event_id * 53) % 300 + case when event_id % 3 = 0 then 8 + k % 15 else 60 + (k * 5) % 160 end as double)",
}
#: Noisy plate texts: some ones read as I, some with an unknown region.
READINGS = {
    "reading_id": "plate_id", "track_id": "plate_id % 500", "confidence": "ocr_confidence", "crop_quality": "plate_crop_quality", "created_at": "created_at",
    "text": "case when plate_id % 9 = 0 then concat('ZZ', substr(plate_number, 2)) when plate_id % 5 = 0 then replace(plate_number, '1', 'I') when plate_id % 11 = 0 then lower(plate_number) else plate_number end",
}

#: Boxes of plates in a camera's frames, some without what their vehicle is called, with what reading their crop gives.
PLATE_BOXES = {
    "camera_id": "user_id % 30", "frame": "event_id", "id": "event_id", "x1": "cast((k % 4) * 150 + event_id % 15 as double)", "y1": "cast((k % 3) * 90 + event_id % 7 as double)",
    "x2": "cast((k % 4) * 150 + event_id % 15 + 25 + k % 40 as double)", "y2": "cast((k % 3) * 90 + event_id % 7 + 9 + k % 11 as double)", "confidence": "cast((c * 3) % 1000 as double) / cast(1000 as double)",
    "vehicle": "case when k % 3 = 1 then cast(k % 4 as bigint) end", "vehicle_group": "case when k % 5 = 2 then cast(k % 2 as bigint) end", "generation": "case when k % 6 > 0 then cast(1 + k % 2 as bigint) end",
    "quality": "cast((c * 7) % 1000 as double) / cast(1000 as double)", "ocr": "cast(c as double) / cast(1000 as double)",
    "text": "case when event_id % 13 = 0 then null when event_id % 5 = 0 then 'B1Z34CD' else concat('B', cast(k % 4 + 1 as varchar(20)), '234CD') end", "created_at": "ts",
}

#: People and vehicles of a camera with box, track, group and a hash of their look; of seven looks each is seen with a few bits changed.
SIGHTINGS = {
    "camera_id": "user_id % 30", "id": "event_id", "object_type": "case when event_type = 'error' then 'person' else 'vehicle' end", "track": "case when k % 5 > 0 then cast(k % 6 as bigint) when k % 10 = 0 then -1 end",
    "person_group": "case when k % 7 = 3 then cast(k % 2 as bigint) end", "x1": "cast((k % 5) * 70 + event_id % 20 as double)", "y1": "cast((k % 3) * 60 + event_id % 10 as double)",
    "x2": "cast((k % 5) * 70 + event_id % 20 + 30 + k % 25 as double)", "y2": "cast((k % 3) * 60 + event_id % 10 + 50 + k % 40 as double)",
    "hash": "case when k % 4 > 0 then concat(substr(md5(cast(k % 9 as varchar(20))), 1, 15), substr(md5(cast(event_id as varchar(20))), 1, 1)) end",
    "plate": "case when k % 3 = 0 then concat('B', cast(k % 8 + 1 as varchar(20)), 'CD') end", "kind": "event_type", "created_at": "ts",
}


def _columns(spec: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in spec.items())


def cte() -> str:
    """The tables as a WITH clause over the driver's tables."""
    return f"""with recursive e as (select {_columns(BASE)} from events),
detections as (select {_columns(DETECTIONS)} from e),
plates as (select {_columns(PLATES)} from e where k % 4 <> 3 and event_type <> 'error'),
cameras as (select {_columns(CAMERAS)} from nation),
boxes as (select {_columns(BOXES)} from e),
readings as (select {_columns(READINGS)} from plates),
plate_boxes as (select {_columns(PLATE_BOXES)} from e),
sightings as (select {_columns(SIGHTINGS)} from e)"""


def _select(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in spec.items()])


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/events.parquet"), BASE)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(base_events(spark, sf_dir), DETECTIONS)


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(base_events(spark, sf_dir).filter("k % 4 <> 3 and event_type <> 'error'"), PLATES)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/nation.parquet"), CAMERAS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(base_events(spark, sf_dir), BOXES)


def plate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(base_events(spark, sf_dir), PLATE_BOXES)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(base_events(spark, sf_dir), SIGHTINGS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(plates(spark, sf_dir), READINGS)
