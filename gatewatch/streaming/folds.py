"""Folds over the rows of a key in order: one step function for batch and for streams.

A step takes (state, row) and returns (state, rows out); state and rows are plain dictionaries. The batch twin walks sorted
partitions and holds one state at a time, so a key may have any number of rows. The stream keeps the state of each key in
Spark's state store, as JSON, and drops it once the watermark passes the time of its latest row by `ttl`; rows that arrive in
one micro-batch are taken in order."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.lineage import shared_folder

Step = Callable[[dict | None, dict], tuple[dict | None, list[dict]]]


def _clean(row: dict) -> dict:
    return {k: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in row.items()}


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


def _names(schema: str) -> list[str]:
    return [f.strip().split()[0] for f in schema.split(",")]


def fold_batch(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, final: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """Rows out of the step for every key, and of `final` for the last state of each key."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                row = _clean(row)
                now = tuple(row[k] for k in keys)
                if now != key:
                    out += final(state) if final and state is not None else []
                    key, state = now, None
                state, more = step(state, row)
                out += more
            yield _frame(out, names)
        if final and state is not None:
            yield _frame(final(state), names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_each(rows: DataFrame, step: Step, schema: str, final: Callable[[dict], list[dict]]) -> DataFrame:
    """The same for rows that are keys of their own: no shuffle."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([out for row in batch.to_dict("records") for out in final(step(None, _clean(row))[0])], names)

    return rows.mapInPandas(run, schema)


def in_order(parts: Iterator[pd.DataFrame], order: list[str], step: int = 10_000) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch in order, by the step. They wait with their texts in Arrow's columns, as a micro-batch may hold any
    number of them."""

    def slim(part: pd.DataFrame) -> pd.DataFrame:
        texts = [c for c in part.columns if part[c].dtype == object and pd.api.types.infer_dtype(part[c], skipna=True) == "string"]
        return part.astype(dict.fromkeys(texts, "string[pyarrow]"))

    every = pd.concat([slim(p) for p in parts], ignore_index=True)
    at = np.lexsort([every[c].to_numpy() for c in reversed(order)])
    for i in range(0, len(at), step):
        yield every.iloc[at[i : i + step]]


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, ttl_ms: int, final: Callable[[dict], list[dict]] | None = None, at: str = "at") -> DataFrame:
    """The same over a stream with a watermark and the rows' time in seconds in `at`; `final` is called when a key's state expires."""
    names = _names(schema)

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            state = json.loads(group.get[0])["state"]
            group.remove()
            yield _frame(final(state) if final else [], names)
            return
        kept = json.loads(group.get[0]) if group.exists else {"state": None, "latest": 0}
        state, latest = kept["state"], kept["latest"]
        for some in in_order(parts, order):
            out: list[dict] = []
            for row in some.to_dict("records"):
                state, more = step(state, _clean(row))
                latest = max(latest, int(row[at] * 1000))
                out += more
            yield _frame(out, names)
        if state is not None:
            group.update((json.dumps({"state": state, "latest": latest}, default=lambda o: o.plain() if hasattr(o, "plain") else str(o)),))
            # by the rows' own time: the watermark is still 0 in the first micro-batch; a late row's state goes at the next one
            group.setTimeoutTimestamp(max(latest + ttl_ms, group.getCurrentWatermarkMs() + 1))

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, which state with several variables and timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, in append mode, into Parquet files of the shared folder, and reads them."""
    spark: SparkSession = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
