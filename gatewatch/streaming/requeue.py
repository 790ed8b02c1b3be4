"""SS-19: vehicles that have no plate yet are read again, a few times at most, by micro-batches that may be repeated.

What waits is a table in the shared folder, one version a batch: batch n reads version n - 1 and writes version n, whole or not at all, so
a repeated batch writes the same again. What was read goes into a folder of the batch. Only two versions are kept."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plates as P

WAITING = "detection_id long, camera_id long, event_key string, retries int"
READ = "detection_id long, camera_id long, event_key string, retries int, plate string, ocr double, valid boolean, cached boolean"


def best_reading(results: DataFrame, fresh: float = 600, least: float = 0.45, sure: float = 0.70) -> DataFrame:
    """detection_id, plate, ocr, valid, cached: the reading of each vehicle (detection_id, seq, text, ocr, cached, age) that counts. A valid
    cached one of `fresh` seconds at most comes first, then the first valid one that is sure, then the last one that is valid or has
    `least` confidence and two characters; none if there is no such reading."""
    read = results.withColumn("c", P.correct(F.col("text"))).select("detection_id", "seq", "ocr", F.coalesce("cached", F.lit(False)).alias("cached"), "age", F.col("c.corrected").alias("plate"), F.col("c.valid").alias("valid"))
    kept = F.when(F.col("cached"), F.col("valid") & (F.col("age") <= fresh)).otherwise(F.col("valid") | ((F.col("ocr") >= least) & (F.length("plate") >= 2)))
    strong = F.col("valid") & (F.col("ocr") >= sure)
    rank = F.struct(F.col("cached").alias("cached"), (strong & ~F.col("cached")).alias("strong"), F.when(F.col("cached") | strong, -F.col("seq")).otherwise(F.col("seq")).alias("seq"))
    return read.filter(F.coalesce(kept, F.lit(False))).groupBy("detection_id").agg(F.max_by(F.struct("plate", "ocr", "valid", "cached"), rank).alias("b")).select("detection_id", "b.*")


def retried(waiting: DataFrame, results: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """What goes on waiting and what was read. A vehicle that was tried in vain has one try more, and goes after `most` of them; one that
    was not tried waits as it did. Keys that are missing are made of camera and vehicle."""
    tried = results.select("detection_id").distinct().withColumn("tried", F.lit(True))
    both = waiting.join(tried, "detection_id", "left").join(best_reading(results), "detection_id", "left")
    key: Column = F.coalesce(F.when(F.trim("event_key") != "", F.col("event_key")), F.concat(F.lit("vehicle:"), F.col("camera_id"), F.lit(":det_"), F.col("detection_id")))
    read = both.filter("plate is not null").select("detection_id", "camera_id", key.alias("event_key"), "retries", "plate", "ocr", "valid", "cached")
    again = both.filter("plate is null").withColumn("retries", (F.col("retries") + F.coalesce(F.col("tried").cast("int"), F.lit(0))).cast("int"))
    return again.filter(F.col("retries") < most).select("detection_id", "camera_id", "event_key", "retries"), read


class Queue:
    """The waiting vehicles in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str, most: int = 3) -> None:
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    def start(self, waiting: DataFrame) -> None:
        waiting.selectExpr("detection_id", "camera_id", "event_key", "coalesce(retries, 0) as retries").filter(F.col("retries") < self.most).write.mode("overwrite").parquet(self.version(-1))

    def version(self, number: int) -> str:
        return f"{self.root}/waiting/version={number}"

    def waiting(self, number: int) -> DataFrame:
        return self.spark.read.schema(WAITING).parquet(self.version(number))

    def read(self) -> DataFrame:
        return self.spark.read.schema(READ).parquet(*self.folders(f"{self.root}/read"))

    def folders(self, path: str) -> list[str]:
        """The folders of a path, a handful or one for each batch, that a batch has finished."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in store.listStatus(target)] if store.exists(target) else []
        return sorted(p.toString() for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def apply(self, results: DataFrame, batch: int) -> None:
        """Takes a batch in; the same batch again changes nothing."""
        waiting, read = retried(self.waiting(batch - 1), results, self.most)
        read.write.mode("overwrite").parquet(f"{self.root}/read/batch={batch}")
        waiting.write.mode("overwrite").parquet(self.version(batch))
        old = self.spark._jvm.org.apache.hadoop.fs.Path(self.version(batch - 2))
        with contextlib.suppress(Exception):  # a folder left over does no harm
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def latest(self) -> DataFrame:
        numbers = [int(p.rpartition("=")[2]) for p in self.folders(f"{self.root}/waiting")]
        return self.waiting(max(numbers))


def run(results: DataFrame, queue: Queue, each_batch: Callable) -> None:
    """Takes all that a stream has now."""
    each_batch(results, f"{queue.root}/progress", queue.apply).awaitTermination()
