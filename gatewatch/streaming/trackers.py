"""Steps over a camera's or a track's rows, for folds.fold_batch and folds.fold_stream. Times are seconds (`at`)."""

from __future__ import annotations

from math import hypot

import numpy as np

from ..operators import merge
from .folds import Step


def generation(gap: float = 8.0) -> Step:
    """SS-3: a track's generation goes up after a gap of more than `gap` seconds, or if time runs back."""

    def step(state, row):
        if state is None:
            state = {"generation": 0, "at": row["at"]}
        else:
            passed = row["at"] - state["at"]
            state = {"generation": state["generation"] + (passed < 0 or passed > gap), "at": row["at"]}
        return state, [{"id": row["id"], "generation": state["generation"]}]

    return step


def crossing() -> Step:
    """SS-4: entry or exit where a track changes sides, unknown elsewhere; side 0 is on the line and keeps what was known."""

    def step(state, row):
        side, before, seen = row["side"], (state or {}).get("side"), "unknown"
        if side and before and side != before and row["camera_direction"] in ("entry", "exit"):
            inward = before == row["outside"]
            way = row["camera_direction"]
            seen = way if inward else {"entry": "exit", "exit": "entry"}[way]
        return {"side": side or before}, [{"id": row["id"], "direction": seen}]

    return step


def plate_track(gap: float, attempts: int = 5) -> tuple[Step, object]:
    """SS-5 to SS-8: a track's readings up to `attempts` a passage; a passage is given out when the track is gone for longer than
    `gap` seconds or ends: its surest reading, the number of readings and their mean confidence."""

    def passage(s):
        return {"track": s["track"], "first_at": s["first"], "last_at": s["last"], "readings": s["n"], "best": s["best"], "best_quality": s["quality"], "confidence": round(s["sum"] / s["n"], 6)}

    def step(state, row):
        out = []
        if state is not None and row["at"] - state["last"] > gap:
            out, state = [passage(state)], None
        if state is None:
            state = {"track": row["track"], "first": row["at"], "last": row["at"], "n": 0, "sum": 0.0, "best": None, "quality": -1.0}
        state["last"] = row["at"]
        if state["n"] < attempts:
            state["n"] += 1
            state["sum"] += row["confidence"]
            if row["quality"] >= state["quality"]:
                state["best"], state["quality"] = row["text"], row["quality"]
        return state, out

    return step, lambda state: [passage(state)]


def cooldown(seconds: float, refresh: bool = False) -> Step:
    """SS-9: drops a key's rows within `seconds` of the kept one; with refresh, of the last one seen."""

    def step(state, row):
        if state is not None and row["at"] - state["at"] <= seconds:
            return ({"at": row["at"]} if refresh else state), []
        return {"at": row["at"]}, [{"id": row["id"]}]

    return step


def person_filter(track: float = 300.0, near: float = 30.0, pixels: float = 45.0, shrink: float = 0.40) -> Step:
    """SS-10: keeps a camera's people that are new and tells why others go: track seen lately, or close to a kept one of like size,
    of the 20 places kept last. Tracks stay until they expire."""

    def step(state, row):
        kept = [k for k in (state or {"kept": []})["kept"] if row["at"] - k["at"] <= max(track, near)]
        reason = None
        places = {id(k) for k in kept[-20:]}
        for k in kept:
            if k["track"] == row["track"] and row["at"] - k["at"] <= track:
                k["at"], reason = row["at"], "track"
                break
            size = abs(k["area"] - row["area"]) / max(k["area"], row["area"], 1e-9)
            if id(k) in places and row["at"] - k["at"] <= near and hypot(k["x"] - row["x"], k["y"] - row["y"]) < pixels and size < shrink:
                reason = "place"
                break
        if reason is None:
            kept = [*kept, {n: row[n] for n in ("at", "track", "x", "y", "area")}]
        return {"kept": kept}, [{"id": row["id"], "reason": reason or "new"}]

    return step


def improvement() -> Step:
    """SS-12: gives out an event again only when a reading improves it."""

    def step(state, row):
        stored, changed = merge.fold(state, {k: row[k] for k in merge.READING})
        return stored, [{"event_key": row["event_key"], "seq": row["seq"], "plate": stored["plate"], "status": stored["status"]}] if changed else []

    return step


def grouping(gap: float = 8.0, least: float = 0.30, expiry: float = 240.0) -> Step:
    """SS-1, SS-2 and SS-21: a stable object for boxes whose tracker id changes. A row joins the object that had its track lately,
    else the one that it overlaps most, at `least`, within `gap` seconds and of its class; one object takes one row a frame.
    `switched` tells that the object had another track before."""

    def step(state, row):
        state = state if isinstance(state, Objects) else Objects(state, gap, expiry)
        found, switched = state.join(row, least)
        return state, [{"id": row["id"], "object": found, "switched": switched}]

    return step


class Objects:
    """The objects of `grouping` in the order of their numbers, in arrays: a row is held against all at once, as there are the more the more a camera sees."""

    ARRAYS = ("no", "x1", "y1", "x2", "y2", "at", "frame", "kind")

    def __init__(self, state: dict | None, gap: float, expiry: float) -> None:
        self.gap, self.expiry, self.next, self.kinds, self.tracks, self.latest = min(gap, expiry), expiry, 1, {}, [], None
        self.columns, self.bound = np.zeros((len(self.ARRAYS), 64)), 64
        if state:
            self.next = state["next"]
            for o in state["objects"]:
                self.enter(len(self.tracks), o["no"], o["box"], o["at"], o["frame"], o["kind"], o["track"])

    def enter(self, i: int, no: int, box: list[float], at: float, frame: int | None, kind: str | None, track: int | None) -> None:
        if i == self.columns.shape[1]:
            self.columns = np.concatenate([self.columns, np.zeros_like(self.columns)], axis=1)
        if i == len(self.tracks):
            self.tracks.append(None)
        self.tracks[i] = track
        self.columns[:, i] = no, *box, at, -np.inf if frame is None else frame, self.kinds.setdefault(kind, len(self.kinds))

    def forget(self, now: float) -> None:
        stay = np.flatnonzero(now - self.columns[5, : len(self.tracks)] <= self.expiry)
        self.tracks = [self.tracks[i] for i in stay]
        self.columns[:, : len(stay)] = self.columns[:, stay]
        self.bound = max(64, 2 * len(stay))

    def join(self, row: dict, least: float) -> tuple[int, bool]:
        """The row's object, and whether it had another track before."""
        box, at, track = [row[n] for n in ("x1", "y1", "x2", "y2")], row["at"], row["track"]
        self.latest = at
        if len(self.tracks) > self.bound:
            self.forget(at)
        no, x1, y1, x2, y2, last, frame, kind = self.columns[:, : len(self.tracks)]
        free = np.flatnonzero((frame != (-np.inf if row["frame"] is None else row["frame"])) & (at - last <= self.gap) & (kind == self.kinds.get(row["kind"], -1)))
        if len(free):
            x1, y1, x2, y2 = x1[free], y1[free], x2[free], y2[free]
            w, h = np.maximum(0.0, np.minimum(x2, box[2]) - np.maximum(x1, box[0])), np.maximum(0.0, np.minimum(y2, box[3]) - np.maximum(y1, box[1]))
            union = (x2 - x1) * (y2 - y1) + (box[2] - box[0]) * (box[3] - box[1]) - w * h
            same = np.fromiter((self.tracks[i] == track for i in free), bool, len(free))
            score = same + np.where(union > 0, w * h / np.where(union > 0, union, 1.0), 0.0)
            best = int(np.argmax(score))  # the first of equals
            if score[best] >= least:
                i = int(free[best])
                switched, found = self.tracks[i] != track, int(no[i])
                self.enter(i, found, box, at, row["frame"], row["kind"], track)
                return found, switched
        self.enter(len(self.tracks), self.next, box, at, row["frame"], row["kind"], track)
        self.next += 1
        return self.next - 1, False

    def plain(self) -> dict:
        """The state as JSON takes it."""
        if self.latest is not None:
            self.forget(self.latest)
        names = {v: k for k, v in self.kinds.items()}
        rows = self.columns[:, : len(self.tracks)].T.tolist()
        return {"next": self.next, "objects": [{"no": int(r[0]), "track": t, "box": r[1:5], "at": r[5], "frame": None if r[6] == -np.inf else int(r[6]), "kind": names[int(r[7])]} for r, t in zip(rows, self.tracks)]}


def target_hold(hold: float, margin: float) -> Step:
    """SS-18: the row in focus stays for `hold` seconds unless another one scores higher by `margin`."""

    def step(state, row):
        if state is None or row["at"] - state["at"] > hold or row["score"] > state["score"] + margin:
            state = {"id": row["id"], "at": row["at"], "score": row["score"]}
        return state, [{"id": row["id"], "focus": state["id"]}]

    return step
