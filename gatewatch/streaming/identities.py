"""SS-1, SS-2 and SS-21: who is who when a tracker changes its numbers.

`ObjectGroups` gives every box of a camera a group that outlives the tracker's number: boxes of a frame, in order, take the group that
fits best under gates of time, distance, size, overlap and look; a group takes one box a frame. `VideoIdentities` links a new
track of a video to an event whose own track is not in the frame any more, by overlap, within a short gap.

Nothing is matched over a silence longer than the longest gap. So the batch twins cut each camera's rows there: a stretch without such a
silence is a key of its own, and the number of keys grows with time, not with cameras."""

from __future__ import annotations

from math import hypot

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .walks import Walk, names_of, walk_batch, walk_stream

GROUPED = "id long, stretch_start double, group_no long, switched boolean, distance double, overlap double"
LINKED = "id long, event_track long, generation long, started boolean"
GROUP = "no long, object_type string, kind string, last_at double, x1 double, y1 double, x2 double, y2 double, track long, tracks array<long>, hash string, frame long"
EVENT = "no long, event_track long, generation long, track long, last_at double, frame long, x1 double, y1 double, x2 double, y2 double, kind string"
PENDING = "id long, at double, frame long, track long, kind string, x1 double, y1 double, x2 double, y2 double"
_GROUP, _EVENT, _PENDING = names_of(GROUP), names_of(EVENT), names_of(PENDING)


def overlap(a: dict, b: dict) -> float:
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h)


def measures(a: dict, b: dict) -> tuple[float, float, float]:
    """Distance of the centres, overlap, and by which share the areas differ."""
    away = hypot((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2, (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2)
    sizes = [max(1.0, x["x2"] - x["x1"]) * max(1.0, x["y2"] - x["y1"]) for x in (a, b)]
    return away, overlap(a, b), abs(sizes[0] - sizes[1]) / max(sizes)


class ObjectGroups(Walk):
    """The groups of one camera: rows have id, at, frame, object_type, kind, track, hash and a box. Groups are numbered from the time
    at which the camera's stretch began.

    The more a camera sees, the more groups are open, so a row is scored against all of its type at once, in arrays, with a little slack; the
    exact score decides among those that may be best."""

    STATES = {"groups": GROUP, "counter": "next long, start double"}
    SLACK = 1e-6

    def __init__(self, gap: float = 8, switch: float = 1.5, expiry: float = 240, reach: float = 120, person_reach: float = 130, like: float = 0.50, least: float = 0.15, switch_least: float = 0.65, most: int = 8, late: float = 3600) -> None:
        # a group that nothing can join any more is forgotten early: rows of a stream come no more than `late` behind each other
        gap, expiry = min(gap, expiry), min(expiry, gap + late)
        self.gap, self.switch, self.expiry, self.reach, self.person_reach, self.like, self.least, self.switch_least, self.most = gap, switch, expiry, reach, person_reach, like, least, switch_least, most
        self.types, self.next, self.start, self.latest = {}, 1, None, None

    @property
    def groups(self) -> list[dict]:
        """All groups in the order of their numbers."""
        return sorted((g for t in self.types.values() for g in t.groups), key=lambda g: g["no"])

    def expired(self, at: float) -> list[dict]:
        for t in self.types.values():
            t.keep(at - t.last_at[: t.n] <= self.expiry)
        return []

    def due(self) -> float | None:
        last = [float(t.last_at[: t.n].min()) for t in self.types.values() if t.n]
        return min(last) + self.expiry if last else None

    def dump(self) -> dict[str, list[tuple]]:
        if self.latest is not None:
            self.expired(self.latest)
        return {"groups": [tuple(g[n] for n in _GROUP) for g in self.groups], "counter": [(self.next, self.start)]}

    def load(self, tables: dict[str, list[tuple]]) -> None:
        self.types = {}
        for g in sorted((dict(zip(_GROUP, g, strict=True)) for g in tables["groups"]), key=lambda g: g["no"]):
            self.of(g["object_type"]).put(g | {"tracks": list(g["tracks"])})
        if tables["counter"]:
            self.next, self.start = tables["counter"][0]

    def of(self, object_type: str | None) -> OpenGroups:
        if object_type not in self.types:
            self.types[object_type] = OpenGroups()
        return self.types[object_type]

    def score(self, g: dict, row: dict, track: int) -> tuple[float, bool, float, float] | None:
        """How well the group fits: a known track beats everything, else overlap and distance; None if a gate is shut."""
        person, silent = row["object_type"] == "person", row["at"] - g["last_at"]
        if g["frame"] == row["frame"] or g["object_type"] != row["object_type"] or silent > self.gap:
            return None
        away, over, other = measures(row, g)
        reach, same = self.person_reach if person else self.reach, track >= 0 and track in (g["track"], *g["tracks"])
        if same:
            if away <= reach * 1.5 or over > 0:
                return 1000.0 - away, False, away, over
        elif not person:
            longest = max(row["x2"] - row["x1"], row["y2"] - row["y1"], g["x2"] - g["x1"], g["y2"] - g["y1"])
            if silent > self.switch or g["kind"] != row["kind"] or over < self.switch_least or away > max(30.0, longest * 0.25):
                return None
        if away > reach or other > self.like:
            return None
        unlike = (int(row["hash"], 16) ^ int(g["hash"], 16)).bit_count() if person and row["hash"] and g["hash"] else None
        if unlike is not None and unlike > 2 * self.most:
            return None
        if (unlike is None or unlike > self.most) and over < self.least and away > reach * 0.65:
            return None
        return over * 100 + 100 - away / max(1.0, reach) * 50, g["track"] != track and g["track"] >= 0 and track >= 0, away, over

    def guessed(self, t: OpenGroups, row: dict, track: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the groups that may fit and their scores, both but for the slack: if some may have the row's track near by, those only."""
        e, person, n = self.SLACK, row["object_type"] == "person", t.n
        reach = self.person_reach if person else self.reach
        at = np.flatnonzero((t.frame[:n] != _number(row["frame"])) & (row["at"] - t.last_at[:n] <= self.gap))
        if not len(at):
            return at, at
        x1, y1, x2, y2 = (c[at] for c in (t.x1, t.y1, t.x2, t.y2))
        x, y = (row["x1"] + row["x2"] - x1 - x2) / 2, (row["y1"] + row["y2"] - y1 - y2) / 2
        away = np.sqrt(x * x + y * y)
        same = t.holds(track)[at] if track >= 0 else np.zeros(len(at), bool)
        if track >= 0:
            # what is surely near leaves nothing to the others
            least = np.where(same, away, np.inf).min()
            if least <= reach * 1.5 - e:
                first = np.flatnonzero(same & (away <= least + 2 * e))
                if len(first) > 1:  # of those as far off in both directions the first one
                    first = first[np.sort(np.unique(np.abs(x[first]) + 1j * np.abs(y[first]), return_index=True)[1])]
                return at[first], 1000.0 - away[first]
        w, h = np.minimum(row["x2"], x2) - np.maximum(row["x1"], x1), np.minimum(row["y2"], y2) - np.maximum(row["y1"], y1)
        near = same & ((away <= reach * 1.5 + e) | ((w > 0) & (h > 0)))
        width, height = row["x2"] - row["x1"], row["y2"] - row["y1"]
        both = np.where((w > 0) & (h > 0), w * h, 0.0)
        union = width * height + (x2 - x1) * (y2 - y1) - both
        over = np.where(both > 0, both / np.where(both > 0, union, 1.0), 0.0)
        sizes = max(1.0, width) * max(1.0, height), np.maximum(1.0, x2 - x1) * np.maximum(1.0, y2 - y1)
        fits = (away <= reach + e) & (np.abs(sizes[0] - sizes[1]) / np.maximum(*sizes) <= self.like + e)
        if not person:
            longest = np.maximum(np.maximum(x2 - x1, y2 - y1), max(width, height))
            fits &= same | ((t.kind[at] == t.kinds.get(row["kind"], -1)) & (row["at"] - t.last_at[at] <= self.switch) & (over >= self.switch_least - e) & (away <= np.maximum(30.0, longest * 0.25) + e))
        may = near | fits
        return at[may], np.where(near, 1000.0 - away, over * 100 + 100 - away / max(1.0, reach) * 50)[may]

    def fitting(self, t: OpenGroups, row: dict, track: int) -> tuple[tuple | None, int | None]:
        """The best score and its group's place, the first one's of equals."""
        places, guesses = self.guessed(t, row, track)
        best, chosen = None, None
        while len(places):
            top = guesses >= guesses.max() - 2 * self.SLACK
            for i in places[top]:
                if best is not None and all(t.groups[i][n] == t.groups[chosen][n] for n in ("x1", "y1", "x2", "y2", "tracks")):
                    continue  # fits no better
                found = self.score(t.groups[i], row, track)
                if found and (best is None or found[0] > best[0]):
                    best, chosen = found, int(i)
            if best is not None:
                return best, chosen
            places, guesses = places[~top], guesses[~top]
        return None, None

    def take(self, row: dict) -> list[dict]:
        self.start = row["at"] if self.start is None else self.start
        self.latest = row["at"]
        track = -1 if row["track"] is None else row["track"]
        t = self.of(row["object_type"])
        if t.n > t.bound:
            t.keep(row["at"] - t.last_at[: t.n] <= self.expiry)
        best, chosen = self.fitting(t, row, track)
        now = {k: row[k] for k in ("x1", "y1", "x2", "y2", "frame")} | {"last_at": row["at"], "track": track}
        look = row["hash"] if row["object_type"] == "person" else None
        if chosen is None:
            chosen = t.put({"no": self.next, "object_type": row["object_type"], "kind": row["kind"], "tracks": [], "hash": look} | now)
            self.next += 1
        g = t.groups[chosen]
        g |= now | ({"hash": look} if look else {})
        if track >= 0 and track not in g["tracks"]:
            g["tracks"] = [*g["tracks"], track]
            t.holds(track)[chosen] = True
        t.note(chosen)
        _, switched, away, over = best or (0.0, False, 0.0, 0.0)
        return [{"id": row["id"], "stretch_start": self.start, "group_no": g["no"], "switched": switched, "distance": away, "overlap": over}]


def _number(frame: int | None) -> float:
    return -np.inf if frame is None else frame


class OpenGroups:
    """Groups of one type in the order of their numbers, with what all are scored by in arrays that grow by doubling."""

    ARRAYS = ("x1", "y1", "x2", "y2", "last_at", "frame", "kind")

    def __init__(self) -> None:
        self.groups: list[dict] = []
        self.bound = 64
        self.tracks: dict[int, np.ndarray] = {}
        self.kinds: dict[str | None, int] = {}
        for name in self.ARRAYS:
            setattr(self, name, np.zeros(16))

    @property
    def n(self) -> int:
        return len(self.groups)

    def holds(self, track: int) -> np.ndarray:
        """Which groups had the track."""
        if track not in self.tracks:
            self.tracks[track] = np.zeros(len(self.x1), bool)
        return self.tracks[track]

    def put(self, g: dict) -> int:
        if self.n == len(self.x1):
            for name in self.ARRAYS:
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(self.n)]))
            self.tracks = {k: np.concatenate([v, np.zeros(self.n, bool)]) for k, v in self.tracks.items()}
        self.groups.append(g)
        for track in {*g["tracks"], g["track"]} - {-1}:
            self.holds(track)[self.n - 1] = True
        self.kind[self.n - 1] = self.kinds.setdefault(g["kind"], len(self.kinds))
        self.note(self.n - 1)
        return self.n - 1

    def note(self, at: int) -> None:
        """Enters the group's box, time and frame as they are now."""
        g = self.groups[at]
        self.x1[at], self.y1[at], self.x2[at], self.y2[at], self.last_at[at], self.frame[at] = g["x1"], g["y1"], g["x2"], g["y2"], g["last_at"], _number(g["frame"])

    def keep(self, these: np.ndarray) -> None:
        """Forgets the other groups; the next time is when as many again have come."""
        self.bound = max(64, 2 * int(these.sum()))
        if these.all():
            return
        stay = np.flatnonzero(these)
        self.groups = [self.groups[i] for i in stay]
        size = len(self.x1)
        for name in self.ARRAYS:
            column = np.zeros(size)
            column[: len(stay)] = getattr(self, name)[stay]
            setattr(self, name, column)
        found = {k: v[stay] for k, v in self.tracks.items()}
        self.tracks = {k: np.concatenate([v, np.zeros(size - len(stay), bool)]) for k, v in found.items() if v.any()}


class VideoIdentities(Walk):
    """The events of one video and type: rows have id, at, frame, track, kind and a box. A frame is judged when the next one begins, as
    all tracks in it must be known; rows without a track are passed over."""

    STATES = {"events": EVENT, "pending": PENDING, "links": "track long, no long", "generations": "track long, generation long, at double", "counter": "next long"}

    def __init__(self, reuse: float = 8, match: float = 1.5, least: float = 0.70) -> None:
        self.reuse, self.match, self.least = reuse, match, least
        self.events, self.pending, self.links, self.generations, self.next = [], [], {}, {}, 1

    def due(self) -> float | None:
        return self.pending[-1]["at"] + self.reuse if self.pending else None

    def dump(self) -> dict[str, list[tuple]]:
        return {
            "events": [tuple(e[n] for n in _EVENT) for e in self.events], "pending": [tuple(r[n] for n in _PENDING) for r in self.pending], "links": [*self.links.items()],
            "generations": [(t, *g) for t, g in self.generations.items()], "counter": [(self.next,)],
        }

    def load(self, tables: dict[str, list[tuple]]) -> None:
        self.events = [dict(zip(_EVENT, e, strict=True)) for e in tables["events"]]
        self.pending = [dict(zip(_PENDING, r, strict=True)) for r in tables["pending"]]
        self.links, self.generations = dict(tables["links"]), {t: (g, at) for t, g, at in tables["generations"]}
        if tables["counter"]:
            (self.next,) = tables["counter"][0]

    def expired(self, at: float) -> list[dict]:
        out = self.judged() if self.pending and at - self.pending[-1]["at"] >= self.reuse else []
        self.forget(at)
        return out

    def forget(self, at: float) -> None:
        self.events = [e for e in self.events if at - e["last_at"] <= self.reuse * 4]
        known = {e["no"] for e in self.events}
        self.links = {t: no for t, no in self.links.items() if no in known}

    def take(self, row: dict) -> list[dict]:
        out = self.judged() if self.pending and self.pending[-1]["frame"] != row["frame"] else []
        self.pending.append({n: row[n] for n in _PENDING})
        return out

    def judged(self) -> list[dict]:
        """The pending frame: each row's event."""
        frame, self.pending, out = self.pending, [], []
        active = {r["track"] for r in frame if r["track"] is not None and r["track"] >= 0}
        for r in frame:
            if r["track"] is None or r["track"] < 0:
                continue
            event = next((e for e in self.events if e["no"] == self.links.get(r["track"])), None)
            if event and r["at"] - event["last_at"] > self.reuse:
                del self.links[r["track"]]
                event = None
            if event is None:
                open_ = [e for e in self.events if r["at"] - e["last_at"] <= self.match and e["frame"] != r["frame"] and e["track"] not in active and e["kind"] == r["kind"]]
                best = max(open_, key=lambda e: overlap(r, e), default=None)
                if best and overlap(r, best) >= self.least:
                    event = best
            started = event is None
            if started:
                last = self.generations.get(r["track"])
                generation = 1 if last is None else last[0] + (r["at"] - last[1] > self.reuse)
                self.generations[r["track"]] = generation, r["at"]
                event = {"no": self.next, "event_track": r["track"], "generation": generation, "kind": r["kind"]}
                self.next += 1
                self.events.append(event)
            self.links[r["track"]] = event["no"]
            event |= {k: r[k] for k in ("x1", "y1", "x2", "y2", "frame", "track")} | {"last_at": r["at"]}
            out.append({"id": r["id"], "event_track": event["event_track"], "generation": event["generation"], "started": started})
        self.forget(frame[-1]["at"])
        return out


def stretches(rows: DataFrame, gap: float) -> DataFrame:
    """rows with `stretch`, the time at which the camera's rows without a silence of more than `gap` began."""
    w = Window.partitionBy("camera_id").orderBy("at", "id")
    return rows.withColumn("stretch", F.last(F.when(F.coalesce(F.col("at") - F.lag("at").over(w) > gap, F.lit(True)), F.col("at")), ignorenulls=True).over(w))


def object_groups(rows: DataFrame, **limits: float) -> DataFrame:
    """id, stretch_start and group_no (which with the camera name a group), switched (another track before), distance, overlap."""
    return walk_batch(stretches(rows, ObjectGroups(**limits).gap), ["camera_id", "stretch"], ["at", "id"], lambda: ObjectGroups(**limits), GROUPED)


def object_groups_stream(rows: DataFrame, **limits: float) -> DataFrame:
    """The same over a stream, a camera being one stretch there."""
    return walk_stream(rows, ["camera_id"], ["at", "id"], lambda: ObjectGroups(**limits), GROUPED)


def video_identities(rows: DataFrame, **limits: float) -> DataFrame:
    """id, event_track, generation, started of every row with a track, by video (camera_id) and object_type."""
    return walk_batch(rows, ["camera_id", "object_type"], ["at", "frame", "id"], lambda: VideoIdentities(**limits), LINKED)


def video_identities_stream(rows: DataFrame, **limits: float) -> DataFrame:
    return walk_stream(rows, ["camera_id", "object_type"], ["at", "frame", "id"], lambda: VideoIdentities(**limits), LINKED)
