"""SS-9 and SS-10: people and vehicles of a camera that were seen lately, told by track, place and look.

`PersonFilter` asks in layers and tells which one knew the person: A its group (or a group known to be the same), B its track, C its place
and size together with its look (or a place next by), D its look alone, E none: the person is new. `VehicleFilter` asks for the
plate's text, the look and the place.

Looks are 64-bit hashes in an index by bands: two hashes that differ in `most` bits at most share one of most + 1 bands, so a look-up
meets only the entries of its own bands. Entries go when their cooldown is over. People are remembered for `keep` seconds after they
were last seen, and names of groups as long as the person that they stand for."""

from __future__ import annotations

from math import hypot

from .walks import Walk, names_of, walk_batch, walk_stream

PERSON = "id long, event long, outcome string, distance double, hamming int"
VEHICLE = "id long, outcome string"
KNOWN = "event long, key string, track long, tracks array<long>, person_group long, x double, y double, area double, hash string, since double, last_at double"
_KNOWN = names_of(KNOWN)


class HashIndex:
    """Hashes with the time that they were entered, found by likeness for `cooldown` seconds."""

    def __init__(self, most: int, cooldown: float) -> None:
        self.most, self.cooldown, self.entries, self.bands = most, cooldown, [], {}
        cuts = [round(64 * i / (most + 1)) for i in range(most + 2)]
        self.cuts = list(zip(cuts, cuts[1:]))

    def places(self, bits: int) -> list[tuple[int, int]]:
        return [(i, bits >> a & (1 << b - a) - 1) for i, (a, b) in enumerate(self.cuts)]

    def add(self, text: str, at: float) -> None:
        entry = text, int(text, 16), at
        self.entries.append(entry)
        for place in self.places(entry[1]):
            self.bands.setdefault(place, []).append(entry)

    def near(self, text: str, at: float) -> bool:
        bits = int(text, 16)
        return any(at - e[2] <= self.cooldown and (e[1] ^ bits).bit_count() <= self.most for place in self.places(bits) for e in self.bands.get(place, ()))

    def forget(self, at: float) -> None:
        """Drops what is over; only when that is a good part, as the index is built anew."""
        left = [e for e in self.entries if at - e[2] <= self.cooldown]
        if len(left) < len(self.entries) // 2 or not left:
            self.entries, self.bands = [], {}
            for text, _, then in left:
                self.add(text, then)


def far(a: str | None, b: str | None) -> int | None:
    return (int(a, 16) ^ int(b, 16)).bit_count() if a and b else None


class PersonFilter(Walk):
    """People of one camera: rows have id, at, track, person_group, x1, y1, x2, y2 and hash."""

    STATES = {"known": KNOWN, "hashes": "hash string, at double", "tracks": "track long, at double", "names": "name string, known string, since double", "generations": "track long, generation long, at double"}

    def __init__(self, cooldown: float = 120, track: float = 300, most: int = 8, reach: float = 130, like: float = 0.45, next_by: float = 60, next_like: float = 0.35, moment: float = 20, shrink: float = 0.60, reuse: float = 8, keep: float = 600) -> None:
        self.cooldown, self.track, self.most, self.reach, self.like, self.next_by, self.next_like, self.moment, self.shrink, self.reuse, self.keep = cooldown, track, most, reach, like, next_by, next_like, moment, shrink, reuse, keep
        self.known: dict[str, dict] = {}
        self.looks, self.tracks, self.names, self.generations, self.cleaned = HashIndex(most, cooldown), {}, {}, {}, 0.0

    def expired(self, at: float) -> list[dict]:
        self.known = {k: m for k, m in self.known.items() if at - m["last_at"] <= self.keep}
        self.names = {n: (k, since) for n, (k, since) in self.names.items() if k in self.known and self.known[k]["since"] == since}
        self.tracks = {t: then for t, then in self.tracks.items() if at - then < self.track}
        self.generations = {t: g for t, g in self.generations.items() if at - g[1] <= self.keep}
        self.looks.forget(at)
        return []

    def due(self) -> float | None:
        times = [m["last_at"] for m in self.known.values()] + [at for _, at in self.generations.values()]
        return max(times) + self.keep if times else None

    def dump(self) -> dict[str, list[tuple]]:
        known = [tuple(m[n] for n in _KNOWN) for m in self.known.values()]
        return {"known": known, "hashes": [(e[0], e[2]) for e in self.looks.entries], "tracks": [*self.tracks.items()], "names": [(n, *k) for n, k in self.names.items()], "generations": [(t, *g) for t, g in self.generations.items()]}

    def load(self, tables: dict[str, list[tuple]]) -> None:
        for m in tables["known"]:
            m = dict(zip(_KNOWN, m, strict=True))
            self.known[m["key"]] = m | {"tracks": list(m["tracks"])}
        for text, at in tables["hashes"]:
            self.looks.add(text, at)
        self.tracks, self.names = dict(tables["tracks"]), {n: (k, since) for n, k, since in tables["names"]}
        self.generations = {t: (g, at) for t, g, at in tables["generations"]}

    def generation(self, track: int, at: float) -> int:
        before = self.generations.get(track)
        now = 1 if before is None or at - before[1] > self.keep else before[0] + (at - before[1] > self.reuse)
        self.generations[track] = now, at
        return now

    def remembered(self, key: str, at: float) -> dict | None:
        m = self.known.get(key)
        return m if m and at - m["last_at"] <= self.keep else None

    def found(self, p: dict, key: str) -> tuple[str, str | None, float, int]:
        """Which layer knows the person, by which key, how far away and how unlike; new if none does."""
        at, named = p["at"], key if p["person_group"] is not None else None
        if named in self.names:
            other, since = self.names[named]
            m = self.remembered(other, at)
            if m and m["since"] == since:  # not another one who was given the same key later
                return "A named", other, 0.0, 0
        seen = [(m, at - m["last_at"]) for m in self.known.values() if at - m["last_at"] <= max(self.cooldown, self.track)]
        if p["person_group"] is not None:
            for m, age in seen:
                if m["person_group"] == p["person_group"] and age <= self.cooldown:
                    return "A group", m["key"], 0.0, 0
        if p["track"] >= 0:
            for m, age in seen:
                if p["track"] in m["tracks"] and age <= self.track:
                    return "B track", m["key"], 0.0, 0
            last = self.tracks.get(p["track"])
            if last is not None and at - last < self.track:
                return "B seen", named, 0.0, 0
            self.tracks[p["track"]] = at
        best = None
        for m, age in seen:
            if age > self.cooldown:
                continue
            away, other, bits = hypot(p["x"] - m["x"], p["y"] - m["y"]), abs(p["area"] - m["area"]) / max(1.0, p["area"], m["area"]), far(p["hash"], m["hash"])
            if away <= self.reach and other <= self.like and bits is not None and bits <= self.most:
                kind = "C look"
            elif away <= self.next_by and other <= self.next_like and age <= self.moment and (bits is None or bits <= self.most + 2):
                kind = "C place"
            else:
                continue
            if best is None or away < best[0]:
                best = away, m, bits or 0, kind
        if best:
            return best[3], best[1]["key"], best[0], best[2]
        if p["hash"]:
            for m, age in seen:
                bits = far(p["hash"], m["hash"])
                if age <= self.cooldown and bits is not None and bits <= self.most and abs(p["area"] - m["area"]) / max(1.0, p["area"], m["area"]) <= self.shrink:
                    return "D look", m["key"], hypot(p["x"] - m["x"], p["y"] - m["y"]), bits
            if self.looks.near(p["hash"], at):
                return "D seen", named, 0.0, 0
        return "E new", None, 0.0, 0

    def take(self, row: dict) -> list[dict]:
        w, h = max(1.0, row["x2"] - row["x1"]), max(1.0, row["y2"] - row["y1"])
        p = row | {"x": (row["x1"] + row["x2"]) / 2, "y": (row["y1"] + row["y2"]) / 2, "area": w * h, "track": -1 if row["track"] is None else row["track"]}
        if p["at"] >= self.cleaned + 10:  # what is over is told by its time: this only saves room
            self.expired(p["at"])
            self.cleaned = p["at"]
        if p["person_group"] is not None:
            key = f"group {p['person_group']}"
        elif p["track"] >= 0:
            key = f"track {p['track']} {self.generation(p['track'], p['at'])}"
        else:
            return []
        outcome, match, away, bits = self.found(p, key)
        if p["track"] >= 0:
            self.tracks[p["track"]] = p["at"]
        now = {"x": p["x"], "y": p["y"], "area": p["area"], "last_at": p["at"]}
        if outcome == "E new":
            if p["hash"]:
                self.looks.add(p["hash"], p["at"])
            before = self.remembered(key, p["at"])
            if before is None:
                self.known.pop(key, None)  # who comes anew stands behind those still known
            self.known[key] = {"since": before["since"] if before else p["at"], "event": p["id"], "key": key, "track": p["track"], "tracks": [p["track"]] if p["track"] >= 0 else [], "person_group": p["person_group"], "hash": p["hash"], **now}
            return [{"id": p["id"], "event": p["id"], "outcome": outcome, "distance": 0.0, "hamming": 0}]
        match = match or key
        m = self.remembered(match, p["at"])
        if m is not None and match != key:
            self.names[key] = match, m["since"]
        if m is not None:
            m |= now | ({"hash": p["hash"]} if p["hash"] else {})
            if p["track"] >= 0 and p["track"] not in m["tracks"]:
                m["tracks"] = [*m["tracks"], p["track"]]
        return [{"id": p["id"], "event": m and m["event"], "outcome": outcome, "distance": away, "hamming": bits}]


class VehicleFilter(Walk):
    """Vehicles of one camera: rows have id, at, plate, hash, x1, y1, x2, y2. A row that a layer holds a duplicate isn't entered in it."""

    STATES = {"plates": "plate string, at double", "hashes": "hash string, at double", "places": "x double, y double, area double, at double"}

    def __init__(self, text: float = 120, look: float = 60, most: int = 3, place: float = 30, near: float = 45, shrink: float = 0.40, history: int = 20) -> None:
        self.text, self.place, self.near, self.shrink, self.history = text, place, near, shrink, history
        self.plates, self.looks, self.places, self.cleaned = {}, HashIndex(most, look), [], 0.0

    def expired(self, at: float) -> list[dict]:
        self.plates = {p: then for p, then in self.plates.items() if at - then < self.text}
        self.places = [p for p in self.places if at - p[3] < self.place]
        self.looks.forget(at)
        return []

    def due(self) -> float | None:
        ends = [max(self.plates.values()) + self.text] if self.plates else []
        ends += [self.looks.entries[-1][2] + self.looks.cooldown] if self.looks.entries else []
        ends += [self.places[-1][3] + self.place] if self.places else []
        return max(ends, default=None)

    def dump(self) -> dict[str, list[tuple]]:
        return {"plates": [*self.plates.items()], "hashes": [(e[0], e[2]) for e in self.looks.entries], "places": [*self.places]}

    def load(self, tables: dict[str, list[tuple]]) -> None:
        self.plates, self.places = dict(tables["plates"]), list(tables["places"])
        for text, at in tables["hashes"]:
            self.looks.add(text, at)

    def take(self, row: dict) -> list[dict]:
        at, outcome = row["at"], "new"
        if at >= self.cleaned + 10:
            self.expired(at)
            self.cleaned = at
        if row["plate"] and at - self.plates.get(row["plate"], -self.text) < self.text:
            outcome = "plate"
        elif row["plate"]:
            self.plates[row["plate"]] = at
        if outcome == "new" and row["hash"]:
            if self.looks.near(row["hash"], at):
                outcome = "look"
            else:
                self.looks.add(row["hash"], at)
        if outcome == "new":
            x, y = (row["x1"] + row["x2"]) / 2, (row["y1"] + row["y2"]) / 2
            area = max(1.0, row["x2"] - row["x1"]) * max(1.0, row["y2"] - row["y1"])
            if any(hypot(x - px, y - py) < self.near and abs(area - a) / max(1.0, area, a) < self.shrink for px, py, a, then in self.places if at - then < self.place):
                outcome = "place"
            else:
                self.places = [*self.places, (x, y, area, at)][-self.history :]
        return [{"id": row["id"], "outcome": outcome}]


def people(rows, **limits):
    """id, event, outcome, distance, hamming of every person with a track or a group; event is the id of the row that was new."""
    return walk_batch(rows, ["camera_id"], ["at", "id"], lambda: PersonFilter(**limits), PERSON)


def people_stream(rows, **limits):
    return walk_stream(rows, ["camera_id"], ["at", "id"], lambda: PersonFilter(**limits), PERSON)


def vehicles(rows, **limits):
    """id, outcome of every vehicle: new, or the layer that knew it."""
    return walk_batch(rows, ["camera_id"], ["at", "id"], lambda: VehicleFilter(**limits), VEHICLE)


def vehicles_stream(rows, **limits):
    return walk_stream(rows, ["camera_id"], ["at", "id"], lambda: VehicleFilter(**limits), VEHICLE)
