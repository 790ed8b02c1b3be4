"""SC-10 and SC-12: live feeds as a stream source in Python: `spark.readStream.format("detection_feed")`.

A feed is an append-only file of JSON lines, one for each camera, in the folder `path`; `feeds` names them, separated by commas (else they
are all that end in .jsonl, and none of them may go away). An offset holds, for each feed, where its last whole line ends. A task reads
`bytes_per_task` of a feed at most. A feed that can't be opened is tried again `tries` times with pauses that double from `pause` seconds
on. One that is still gone when the end is looked for stands where it was; where that is not known, after a restart, the stream
fails rather than lose or repeat rows. One that goes while it is read fails the batch, which then runs again."""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "feed string, frame long, at timestamp, track long, object_type string, confidence double, x1 double, y1 double, x2 double, y2 double"


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def opened(path: str, tries: int, pause: float):
    """The file, tried `tries` times with pauses that double."""
    for n in range(tries):
        try:
            return open(path, "rb")
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(pause * 2**n)
    raise ValueError("tries must be 1 at least")


def last_line(path: str, tries: int, pause: float) -> int:
    """Where the last whole line ends."""
    with opened(path, tries, pause) as f:
        at = os.fstat(f.fileno()).st_size
        while at > 0:
            start = max(0, at - (1 << 16))
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
        return 0


def rows_of(piece: Piece, schema: StructType, tries: int, pause: float) -> Iterator[tuple]:
    """The rows whose lines begin in a piece; a line that is no JSON object of such values is passed over, as a broken frame is."""
    kinds = {f.name: f.dataType.typeName() for f in schema}
    feed = os.path.splitext(os.path.basename(piece.path))[0]
    make = {"long": int, "integer": int, "double": float, "timestamp": datetime.fromisoformat, "string": str, "boolean": bool}
    with opened(piece.path, tries, pause) as f:
        f.seek(max(0, piece.start - 1))
        if piece.start:
            f.readline()  # the rest of the line before
        while f.tell() < piece.end:
            try:
                found = {"feed": feed} | json.loads(f.readline())
                yield tuple(None if found.get(n) is None else make[k](found[n]) for n, k in kinds.items())
            except (ValueError, TypeError):
                continue


class _Reader:
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.names = schema, options["path"], [n for n in options.get("feeds", "").split(",") if n]
        self.tries, self.pause, self.size = int(options.get("tries", 3)), float(options.get("pause", 0.1)), int(options.get("bytes_per_task", 64 << 20))

    def feeds(self) -> list[str]:
        return [os.path.join(self.path, f"{n.strip()}.jsonl") for n in self.names] or sorted(glob.glob(os.path.join(self.path, "*.jsonl")))

    def pieces(self, path: str, start: int, end: int) -> list[Piece]:
        return [Piece(path, at, min(end, at + self.size)) for at in range(start, end, self.size)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows_of(partition, self.schema, self.tries, self.pause)


class FeedReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return [x for p in self.feeds() for x in self.pieces(p, 0, last_line(p, self.tries, self.pause))] or [Piece(os.devnull, 0, 0)]


class FeedStreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in self.feeds():
            try:
                self.known[path] = max(self.known.get(path, 0), last_line(path, self.tries, self.pause))
            except OSError:
                if path not in self.known:
                    raise
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = {**self.known, **{p: max(at, self.known.get(p, 0)) for p, at in end.items()}}
        return [x for p, at in end.items() for x in self.pieces(p, start.get(p, 0), at)]

    def commit(self, end: dict) -> None:
        pass


class DetectionFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "detection_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DetectionFeed)
