"""What the training-data operators share: tables, scratch space and text helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Words in a shingle, and the similarity from which two documents are near duplicates.
SHINGLE, NEAR = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="gatewatch-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/gatewatch-{sc.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """Writes df as a table bucketed by key, so that joins on the key don't move it; and what deletes the table again. Rows that
    the plan has already dealt out by key go straight to their bucket's file."""
    spark = df.sparkSession
    name, folder = f"gatewatch_{uuid.uuid4().hex[:12]}", f"{shared_dir(spark)}/table-{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", folder).format("parquet").saveAsTable(name)
    table = spark.table(name)

    def drop() -> None:
        spark.sql(f"drop table {name}")
        discard(table)

    return table, drop


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file into the shared folder and returns its path."""
    path = f"{shared_dir(spark)}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()
    return path


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
