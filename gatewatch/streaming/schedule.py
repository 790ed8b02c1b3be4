"""SS-14: which camera's frame is worked on next. Of every camera only its newest waiting frame counts; a worker takes `capacity` of its
cameras a tick, those first that were served longest ago, none again within `interval`. Cameras are dealt to workers, so that no
one place sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import Walk, walk_batch, walk_stream

SERVED = "worker long, tick long, camera_id long, id long, waited double, replaced long"


class FairSchedule(Walk):
    """One worker: rows have worker, camera_id, id and at. What waits when a tick ends is served at that end."""

    STATES = {"waiting": "camera_id long, id long, at double, replaced long", "served": "camera_id long, at double", "clock": "worker long, tick long"}

    def __init__(self, capacity: int = 1, interval: float = 0.0, tick: float = 1.0) -> None:
        self.capacity, self.interval, self.length = capacity, interval, tick
        self.waiting, self.served, self.worker, self.tick = {}, {}, None, None

    def dump(self) -> dict[str, list[tuple]]:
        return {"waiting": [(c, *w) for c, w in self.waiting.items()], "served": [*self.served.items()], "clock": [] if self.tick is None else [(self.worker, self.tick)]}

    def load(self, tables: dict[str, list[tuple]]) -> None:
        self.waiting, self.served = {c: tuple(w) for c, *w in tables["waiting"]}, dict(tables["served"])
        if tables["clock"]:
            self.worker, self.tick = tables["clock"][0]

    def due(self) -> float | None:
        return (self.tick + 1) * self.length if self.waiting else None

    def serve(self) -> list[dict]:
        """Ends the tick."""
        end, out = (self.tick + 1) * self.length, []
        ready = [c for c in self.waiting if end - self.served.get(c, float("-inf")) >= self.interval]
        for camera in sorted(ready, key=lambda c: (self.served.get(c, float("-inf")), c))[: self.capacity]:
            frame, at, replaced = self.waiting.pop(camera)
            self.served[camera] = end
            out.append({"worker": self.worker, "tick": self.tick, "camera_id": camera, "id": frame, "waited": round(end - at, 6), "replaced": replaced})
        self.tick += 1
        return out

    def until(self, tick: float) -> list[dict]:
        """Ends all ticks before this one; those in which nothing can be served are passed over."""
        out = []
        while self.waiting and self.tick < tick:
            found = self.serve()
            out += found
            if not found and self.waiting:  # all of them rest: on to when the first may be served again
                first = min(self.served[c] for c in self.waiting) + self.interval
                self.tick = max(self.tick, int(first / self.length) - 1)
        return out

    def take(self, row: dict) -> list[dict]:
        now, out = int(row["at"] // self.length), []
        self.worker = row["worker"]
        if self.tick is not None:
            out = self.until(now)
        self.tick = now
        before = self.waiting.get(row["camera_id"])
        self.waiting[row["camera_id"]] = row["id"], row["at"], before[2] + 1 if before else 0
        return out

    def expired(self, at: float) -> list[dict]:
        return [] if self.tick is None else self.until(at // self.length if at < float("inf") else float("inf"))


def dealt(rows: DataFrame, workers: int) -> DataFrame:
    return rows.withColumn("worker", F.pmod(F.col("camera_id"), F.lit(workers)))


def served(rows: DataFrame, workers: int, **limits: float) -> DataFrame:
    """worker, tick, camera_id, id, waited, replaced (frames that gave way) of every frame that is worked on."""
    return walk_batch(dealt(rows, workers), ["worker"], ["at", "id"], lambda: FairSchedule(**limits), SERVED)


def served_stream(rows: DataFrame, workers: int, **limits: float) -> DataFrame:
    return walk_stream(dealt(rows, workers), ["worker"], ["at", "id"], lambda: FairSchedule(**limits), SERVED)
