"""SC-13 and AG-22: streams as jobs that are submitted, watched and read, with what a listener and observed metrics tell of them."""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "job string, batch long, rows long, rows_per_second double, milliseconds long, metrics map<string,string>"
STATUS = "job string, path string, status string, batches long, rows long, error string"
#: Progress reports that are kept.
KEPT = 10_000


class Progress(StreamingQueryListener):
    """The progress of every stream, newest last, and how streams ended."""

    def __init__(self) -> None:
        self.lock, self.rows, self.ends = threading.Lock(), deque(maxlen=KEPT), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {f"{name}.{k}": None if v is None else str(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        with self.lock:
            self.rows.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration, metrics))

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ends[str(event.id)] = event.exception


class Jobs:
    """Jobs of one session. A job reads a path of one of the given kinds and writes Parquet into the shared folder."""

    def __init__(self, spark: SparkSession, root: str, kinds: tuple[str, ...] = ("parquet", "json", "csv", "orc")) -> None:
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds
        self.progress, self.jobs = Progress(), {}
        spark.streams.addListener(self.progress)

    def close(self) -> None:
        self.spark.streams.removeListener(self.progress)

    def submit(self, path: str, build: Callable[[str], DataFrame], **metrics: Column) -> str:
        """Starts a job over all that is at the path; `metrics` are observed for each micro-batch. Returns the job's name."""
        if path.rstrip("/").rpartition(".")[2].lower() not in self.kinds:
            raise ValueError(f"a job reads {', '.join(self.kinds)}")
        name = f"job_{uuid.uuid4().hex[:12]}"
        stream = build(path)
        stream = stream.observe("job", *[c.alias(n) for n, c in metrics.items()]) if metrics else stream
        writer = stream.writeStream.queryName(name).format("parquet").option("path", f"{self.root}/{name}/rows").option("checkpointLocation", f"{self.root}/{name}/progress")
        self.jobs[name] = path, writer.trigger(availableNow=True).start(), stream.schema
        return name

    def query(self, job: str) -> StreamingQuery:
        return self.jobs[job][1]

    def wait(self, job: str) -> None:
        """Until the job has ended, well or not."""
        try:
            self.query(job).awaitTermination()
        except Exception:  # its status tells
            pass

    def status(self, job: str) -> str:
        query = self.query(job)
        return "running" if query.isActive else "failed" if query.exception() else "finished"

    def statuses(self) -> DataFrame:
        """job, path, status, batches, rows, error."""
        with self.progress.lock:
            seen = list(self.progress.rows)
        rows = []
        for job, (path, query, _) in self.jobs.items():
            mine = [r for r in seen if r[0] == job]
            error = query.exception()
            rows.append((job, path, self.status(job), len(mine), sum(r[2] for r in mine), str(error).splitlines()[0][:500] if error else None))
        return self.spark.createDataFrame(rows, STATUS)

    def table(self) -> DataFrame:
        """The progress of all micro-batches with their metrics."""
        with self.progress.lock:
            rows = list(self.progress.rows)
        return self.spark.createDataFrame(rows, PROGRESS)

    def result(self, job: str) -> DataFrame:
        """The rows of a finished job."""
        if self.status(job) != "finished":
            raise ValueError(f"{job} is {self.status(job)}")
        _, _, schema = self.jobs[job]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{job}/rows")

