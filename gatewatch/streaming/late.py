"""SS-11: plates that are read after their vehicle was seen, by state and timers of a camera's track number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.state import GroupState

#: Arrays of a key: vehicles' times, ids, whether they have no id and whether a plate was found; plates' times and ids.
TYPES = {"at": np.int64, "ids": np.int64, "nameless": bool, "met": bool, "p_at": np.int64, "p_ids": np.int64}
STATE = ", ".join(f"{n} binary" for n in TYPES)
#: Vehicles with the stretch of plates that each has of `plates`; vehicles without one where that is null.
SPANS = {"ids": np.int64, "nameless": bool, "first": np.int64, "count": np.int64}
FOUND = ", ".join(f"{n} binary" for n in [*SPANS, "plates"])
VEHICLES, PAIRS = 50_000, 100_000  # given out at once


def reach(at: np.ndarray, plates: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vehicle the first of the sorted plates from its time on, and how many follow within the span."""
    first = np.searchsorted(plates, at, "left")
    return first, np.searchsorted(plates, at + span, "right") - first


def pairs(first: np.ndarray, count: np.ndarray, step: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that `reach` tells of, as places of vehicles and of plates, by the step."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, step):
        stop = min(start + step, total)
        some = np.arange(np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right") + 1)
        began = ends[some] - count[some]
        n = np.minimum(ends[some], stop) - np.maximum(began, start)
        yield np.repeat(some, n), np.arange(start, stop) + np.repeat(first[some] - began, n)


def _frames(ids: np.ndarray, nameless: np.ndarray, first: np.ndarray, count: np.ndarray, plates: np.ndarray | None) -> Iterator[pd.DataFrame]:
    for i in range(0, len(ids), VEHICLES):
        part = slice(i, i + VEHICLES)
        low = int(first[part].min())
        some = None if plates is None else plates[low : int((first[part] + count[part]).max())].tobytes()
        yield pd.DataFrame([[a.tobytes() for a in (ids[part], nameless[part], first[part] - low, count[part])] + [some]], columns=[*SPANS, "plates"], dtype=object)


def follow(seconds: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Step of a key whose rows have `at` in microseconds, `id`, `nameless` (no id) and `plate` (else a vehicle).

    All lies in arrays sorted by time, so a vehicle's plates are a stretch of them. A vehicle waits until the watermark has passed its
    span, a plate until the watermark has passed the plate: no vehicle before it can come any more."""
    span = seconds * 1_000_000

    def run(_: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        blobs = group.get if group.exists else [b""] * len(TYPES)
        at, ids, nameless, met, p_at, p_ids = (np.frombuffer(b, t) for b, t in zip(blobs, TYPES.values()))
        if not group.hasTimedOut:
            rows = pd.concat([p[["at", "id", "nameless", "plate"]] for p in parts], ignore_index=True).sort_values("at", kind="stable")
            new, came = rows[~rows["plate"]], rows[rows["plate"]]
            new_at, new_ids, new_nameless, came_at, came_ids = new["at"].to_numpy(), new["id"].to_numpy(), new["nameless"].to_numpy(bool), came["at"].to_numpy(), came["id"].to_numpy()
            # those that wait meet the plates that came, new ones all plates
            first, count = reach(at, came_at, span)
            if count.any():
                yield from _frames(ids, nameless, first, count, came_ids)
            every = np.concatenate([p_at, came_at])
            order = np.argsort(every, kind="stable")
            p_at, p_ids = every[order], np.concatenate([p_ids, came_ids])[order]
            first, n = reach(new_at, p_at, span)
            if n.any():
                yield from _frames(new_ids, new_nameless, first, n, p_ids)
            every = np.concatenate([at, new_at])
            order = np.argsort(every, kind="stable")
            at, ids, nameless, met = every[order], np.concatenate([ids, new_ids])[order], np.concatenate([nameless, new_nameless])[order], np.concatenate([met | (count > 0), n > 0])[order]
        passed = group.getCurrentWatermarkMs() * 1000
        alone = (at + span <= passed) & ~met
        if alone.any():
            none = np.zeros(alone.sum(), np.int64)
            yield from _frames(ids[alone], nameless[alone], none, none, None)
        waits, stays = at + span > passed, p_at > passed
        at, ids, nameless, met, p_at, p_ids = at[waits], ids[waits], nameless[waits], met[waits], p_at[stays], p_ids[stays]
        if len(at) or len(p_at):
            group.update(tuple(a.tobytes() for a in (at, ids, nameless, met, p_at, p_ids)))
            due = int(at[0]) + span if len(at) else int(p_at[-1])
            group.setTimeoutTimestamp(max(due // 1000 - 1, group.getCurrentWatermarkMs() + 1))  # a timer runs once the watermark is beyond it
        elif group.exists:
            group.remove()

    return run


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `follow` found as rows of a vehicle and a plate."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, nameless, first, count = (np.frombuffer(row[n], t) for n, t in SPANS.items())
            if row["plates"] is None:
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nameless), pa.nulls(len(ids), pa.int64())], ["vehicle", "reading"])
                continue
            plates = np.frombuffer(row["plates"], np.int64)
            for i, j in pairs(first, count):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], mask=nameless[i]), pa.array(plates[j])], ["vehicle", "reading"])
