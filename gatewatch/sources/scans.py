"""Sources beside the logical tables: JDBC, capture metadata in JSON, files' sizes, synthetic events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "base_name string, timestamp string, time_epoch double, context string, track_id long, vehicle_id long, plate_number string, raw_ocr_text string, confidence double, valid boolean, status string, candidates array<struct<text:string,raw_text:string,confidence:double,variant:string,region_code:string>>"


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database, read in `parts` ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        low, high = spark.read.format("jdbc").option("url", url).option("query", f"select min({key}) a, max({key}) b from {table}").options(**options).load().first()
        reader = reader.option("partitionColumn", key).option("lowerBound", low or 0).option("upperBound", high or 0).option("numPartitions", parts)
    return reader.load()


def captures(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """Capture metadata, one JSON document a file, changed since a time: files are pruned by their time before they are read."""
    reader = spark.read.schema(CAPTURE).option("multiLine", True)
    if since:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.json(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Number and megabytes of the files under a path; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 2).alias("mb"))


def row_counts(**tables: DataFrame) -> DataFrame:
    found = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        found = one if found is None else found.unionByName(one)
    return found


def columns(table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(table.schema)], "position int, name string, type string")


def demo_events(spark: SparkSession, n: int, start: str = "2024-01-01", days: int = 30, seed: int = 7) -> DataFrame:
    """Synthetic detections: busy hours weigh more, three in four are vehicles, 65 % of these have a plate, a fifth of the plates is poor.

    Every draw is a hash of the row's number, so the rows do not depend on how they are dealt."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
    rows = spark.range(n)
    hour = F.when(u(1) < 0.35, 7 + F.floor(u(2) * 3)).when(u(1) < 0.7, 16 + F.floor(u(2) * 3)).otherwise(F.floor(u(2) * 24))
    day = F.floor(u(3) * days).cast("int")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + day * 86400 + hour * 3600 + F.floor(u(4) * 3600))
    kind = F.when(u(5) < 0.75, "vehicle").otherwise("person")
    plate = (kind == "vehicle") & (u(6) < 0.65)
    quality = F.when(u(7) < 0.05, "failed").when(u(7) < 0.20, "poor").otherwise("good")
    number = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("B", "D", "AB", "L")]), (F.floor(u(8) * 4) + 1).cast("int")), (1 + F.floor(u(9) * 9998)).cast("string"), F.lit("XY"))
    return rows.select(F.col("id").alias("detection_id"), (F.floor(u(10) * 6) + 1).cast("long").alias("camera_id"), at.alias("created_at"), kind.alias("object_type"), F.when(plate, number).alias("plate_number"), F.when(plate, quality).alias("quality"))
