"""Suffix-array dedup: removes every byte that a LENGTH-byte string covers which starts anywhere else as well.

Equal texts are one text with a count; a text of LENGTH bytes or more that occurs twice is repeated throughout. In the distinct
texts, every window of LENGTH bytes names one of its GRAM-byte strings, the rightmost one with the least hash, as its anchor.
Equal windows name equal anchors at the same offset, so windows with different anchors are never compared. The windows that
name the same occurrence are consecutive; with the bytes they cover they are a stretch of text:

1. stretches that occur twice as a whole are repeated (a count by digest within the anchor, aggregated before the shuffle);
2. of anchors with several different stretches, one of each kind goes to a shard, which all stretches of the anchor share.
   Every shard builds a suffix array by Larsson-Sadakane refinement: suffixes sorted by their first 8 bytes, then in rounds
   that double the depth and only sort groups that are still tied; Kasai's algorithm gives the common prefixes, for all
   stretches in step. Windows next to each other with LENGTH common bytes are repeated;
3. an anchor with more than PIECE different stretches is cut into pieces, a suffix array each, and every piece is merged
   with every other by binary search for its windows.

Only texts that share an anchor go into step 2, and texts are shuffled once: they lie in a table bucketed by text number, and
the later steps bring their small lists to it. Spans are judged on the input; overlaps count; matches do not cross texts.

Defined cases: null and empty texts, and those under LENGTH bytes, lose nothing; null doc_ids and repeated rows each get their
row, repeated rows being copies of each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, table

LENGTH, GRAM = 200, 40
#: Stretches in a shard and of an anchor's piece at most, and windows handled at once.
SHARD, PIECE, CHUNK = 4000, 20_000, 1 << 20
#: A key with more than a HOT-th of the rows is joined without moving them.
HOT = 1000
#: The rolling hash's base, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = f"{base}:{n}"
    if key not in _powers:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(raw: np.ndarray, k: int = GRAM) -> np.ndarray:
    size = CHUNK + 4 * LENGTH
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(BASE, size)[: len(raw)], out=sums[1:], dtype=np.uint64)
    return mix((sums[k:] - sums[:-k]) * _power(INVERSE, size)[: len(raw) - k + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(raw: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of text: first window, number of windows, anchor's place and hash of every stretch."""
    hashes = gram_hashes(raw, k)
    place_bits = np.uint64((1 << 22) - 1)
    ranked = (hashes & ~place_bits) | (place_bits - np.arange(len(hashes), dtype=np.uint64))  # of equal ones the rightmost is least
    anchor = (place_bits - (sliding_least(ranked, length - k + 1) & place_bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    return first, np.diff(first, append=len(anchor)), anchor[first], hashes[anchor[first]].view(np.int64)


def anchors(texts: DataFrame) -> DataFrame:
    """hash, digest, n, first, windows, offset of every stretch of the texts (n, data)."""
    names = ["hash", "digest", "n", "first", "windows", "offset"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] for _ in names]
            for n, data in zip(batch["n"].to_pylist(), batch["data"].to_pylist()):
                for at in range(0, len(data) - LENGTH + 1, CHUNK):
                    piece = data[at : at + CHUNK + LENGTH - 1]
                    first, windows, place, hashes = stretches(np.frombuffer(piece, np.uint8))
                    offset = place - first
                    digest = [xxhash.xxh3_64_intdigest(piece[a:b], o) for a, b, o in zip(first.tolist(), (first + windows + LENGTH - 1).tolist(), offset.tolist())]
                    for out, part in zip(found, (hashes, np.array(digest, np.uint64).view(np.int64), np.full(len(first), n), first + at, windows, offset)):
                        out.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(found, kinds)], names)

    return texts.select("n", "data").mapInArrow(run, "hash long, digest long, n long, first int, windows int, offset int")


def suffix_array(text: np.ndarray, end: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` bytes, and every suffix's rank; a suffix ends with its stretch, end[i] for suffix i.

    A rank is the place of the last suffix of its group. Each round sorts the suffixes of tied groups by the rank `h` bytes on
    and splits the groups; groups of one are never looked at again."""
    n = len(text)
    left = end - np.arange(n, dtype=np.int32)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven bytes at nine bits
        key <<= np.uint64(9)
        key |= padded[j : n + j] * (left > j)
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    fresh = np.flatnonzero(np.append(sorted_key[1:] != sorted_key[:-1], True))  # ends of the groups
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(fresh, np.diff(fresh, prepend=-1))
    h = 7
    while h < depth:
        size = np.diff(fresh, prepend=-1)
        tied = np.repeat(size > 1, size)
        where = np.flatnonzero(tied)  # places in the order
        if not len(where):
            break
        step = min(h, depth - h)
        some = order[where]
        ahead = np.where(left[some] > step, rank[np.minimum(some + step, n - 1)] + 1, 0)
        again = np.argsort(rank[some] * np.int64(n + 1) + ahead)
        some, ahead, group = some[again], ahead[again], rank[some][again]
        order[where] = some
        last = np.append((ahead[1:] != ahead[:-1]) | (group[1:] != group[:-1]), True)
        ends = np.flatnonzero(last)
        rank[some] = np.repeat(where[ends], np.diff(ends, prepend=-1))
        single = fresh[size == 1]
        fresh = np.sort(np.concatenate([single, where[ends]]))
        h += step
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before, `most` at most: Kasai's algorithm, along all stretches in step.

    The order is by the first `most` bytes, so a suffix inherits its predecessor's length less one only where the suffix after
    the earlier neighbour still sorts strictly before it; within a tied group the length is `most`, else it starts from 0."""
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    out, kept, after = np.zeros(len(order), np.int32), np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
    stop, last = end[start], len(text) - 1
    for t in range(int((stop - start).max(initial=0))):
        live = np.flatnonzero(start + t < stop)
        i = start[live] + t
        r = place[i]
        j = order[np.maximum(r - 1, 0)]
        limit = np.where(r > 0, np.minimum(np.minimum(end[i] - i, end[j] - j), most), 0)
        inherits = rank[np.minimum(after[live], last)] < rank[i]
        h = np.where(rank[j] == rank[i], limit, np.where(inherits, np.minimum(np.maximum(kept[live] - 1, 0), limit), 0))
        going = np.flatnonzero(h < limit)
        while len(going):
            same = text[i[going] + h[going]] == text[j[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < limit[going]]
        h[r == 0] = 0
        out[r], kept[live], after[live] = h, h, j + 1
    return out


class Stretches:
    """The stretches of a shard or piece, and the windows of theirs that are repeated."""

    def __init__(self, data: list[bytes], windows: np.ndarray, twice: np.ndarray):
        length = np.array([len(d) for d in data], np.int64)
        self.start = np.cumsum(length) - length
        self.text = np.frombuffer(b"".join(data), np.uint8)
        self.end = np.repeat(self.start + length, length).astype(np.int32)
        owner = np.repeat(np.arange(len(data)), length)
        own = np.arange(len(self.text)) - self.start[owner] < windows[owner]
        self.order, rank = suffix_array(self.text, self.end)
        prefix = common_prefixes(self.text, self.order, rank, self.start, self.end)
        run = np.cumsum(prefix < LENGTH) - 1
        in_order = own[self.order]
        self.windows = self.order[in_order]  # windows of the stretches themselves, sorted
        self.run = run[in_order]
        count = np.bincount(self.run, minlength=run[-1] + 1 if len(run) else 0)
        known = np.bincount(self.run, twice[owner[self.windows]], minlength=len(count)) > 0
        self.repeated = np.zeros(len(self.text), bool)
        self.repeated[self.windows] = (count >= 2)[self.run] | known[self.run]

    def blocks(self) -> np.ndarray:
        """The windows' bytes in order: sorted strings of LENGTH bytes."""
        return np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[self.windows].copy().view(f"V{LENGTH}").ravel()

    def merge(self, other: Stretches) -> None:
        """Marks the windows that the other piece has as well: a binary search for each of the other's in this one's order."""
        mine, theirs = self.blocks(), other.blocks()
        if not len(mine) or not len(theirs):
            return
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine))
        wide = lambda x: x.view(np.uint8).reshape(-1, LENGTH)
        a, b = wide(mine), wide(theirs)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            differs = a[middle] != b[open_]
            at = differs.argmax(1)
            less = differs.any(1) & (a[middle, at] < b[open_, at])
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
        hit = np.minimum(low, len(mine) - 1)
        found = (a[hit] == b).all(1)
        other.repeated[other.windows[found]] = True
        self.repeated[self.windows[np.isin(self.run, self.run[hit[found]])]] = True


def _marked(shard: Stretches, n: np.ndarray, first: np.ndarray, windows: np.ndarray, ask: np.ndarray) -> list[tuple[int, int, int]]:
    """Text, start and end of the runs of repeated windows in the stretches asked about."""
    out = []
    for k in np.flatnonzero(ask).tolist():
        flags = shard.repeated[shard.start[k] : shard.start[k] + windows[k]]
        if flags.any():
            edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
            base = int(first[k])
            out += [(int(n[k]), base + a, base + b - 1 + LENGTH) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """base: doc_id, n, n_bytes, sha256 of every row; nodes: n, copies, rep of every distinct text. n is a hash of the text's digest that no two texts share."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    plain = docs.select("doc_id", F.unhex(F.md5(data)).alias("key"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha256"))
    base = materialize(plain, "base")
    keys = base.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n_bytes"))
    salt = 0
    while True:
        nodes = materialize(keys.withColumn("n", F.xxhash64("key", F.lit(salt))), "nodes")
        if not nodes.groupBy("n").count().filter("count > 1").limit(1).count():
            return base, nodes
        salt += 1


def _join(rows: DataFrame, counts: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows with the columns of counts, a written table that tells in `count` how many of the rows each of its keys has.

    Keys with more than a HOT-th of all rows are fewer than HOT whatever the data, so these are listed and broadcast, and their rows
    stay where they lie; the other keys are small, and their rows are dealt out by key."""
    frequent = [r[0] for r in counts.filter(F.col(count) * HOT > rows.count()).select(on[-1]).collect()]
    if not frequent:
        return rows.join(counts, on).drop(count)
    hot = F.col(on[-1]).isin(frequent)
    kept = rows.filter(hot).join(F.broadcast(counts.filter(hot)), on)
    return kept.unionByName(rows.filter(~hot).join(counts.filter(~hot), on)).drop(count)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (doc_id, text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base, nodes = _numbered(docs)
    long_nodes = nodes.filter(F.col("n_bytes") >= LENGTH)
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", data.alias("data")).filter(F.octet_length("data") >= LENGTH).withColumn("key", F.unhex(F.md5("data")))
    chosen = rows.join(long_nodes.select("key", "n", "copies", "rep"), "key").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    texts, drop = bucketed(chosen.select("n", "copies", "data").repartition(parts, "n"), "n")

    found = materialize(anchors(texts.select("n", "data")), "anchors")
    several = materialize(found.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1"), "several")
    copies = nodes.filter("copies > 1").select("n", F.lit(True).alias("copied"))
    shared = materialize(_join(found, several, ["hash"], "c").join(copies, "n", "left").withColumn("copied", F.coalesce("copied", F.lit(False))), "shared")
    kinds = shared.groupBy("hash", "digest").agg(F.count("*").alias("times"), F.max("copied").alias("copied"), F.min(F.struct("n", "first", "windows", "offset")).alias("one"))
    kinds = materialize(kinds.withColumn("twice", (F.col("times") > 1) | F.col("copied")), "kinds")
    whole = _join(shared.filter(~F.col("copied")), kinds.filter("twice").select("hash", "digest", "times"), ["hash", "digest"], "times")
    whole = whole.select("n", F.col("first").alias("start"), (F.col("first") + F.col("windows") + LENGTH - 1).alias("end"))

    variety = kinds.groupBy("hash").agg(F.count("*").alias("v"), F.min("twice").alias("all")).filter("v > 1 and not all").select("hash", "v", F.col("v").alias("rows"))
    variety = materialize(variety, "variety")
    work = _join(kinds, variety, ["hash"], "rows").select("hash", "twice", "v", "one.n", "one.first", "one.windows", "one.offset")
    work = materialize(work, "work")
    shards = max(1, work.count() // SHARD)
    # the stretches' bytes, cut where the texts lie
    lists = work.groupBy("n").agg(F.collect_list(F.struct("hash", "twice", "v", "first", "windows", "offset")).alias("list"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s["hash"], s["twice"], s["v"], n, s["first"], s["windows"], data[s["first"] : s["first"] + s["windows"] + LENGTH - 1]) for n, data, found in zip(batch["n"].to_pylist(), batch["data"].to_pylist(), batch["list"].to_pylist()) for s in found]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(types)], ["hash", "twice", "v", "n", "first", "windows", "data"])

    pieces = texts.select("n", "data").join(lists, "n").select("n", "data", "list").mapInArrow(cut, "hash long, twice boolean, v long, n long, first int, windows int, data binary")
    parted = F.ceil(F.col("v") / PIECE).cast("int")
    piece = F.pmod(F.xxhash64("n", "first"), parted).cast("int")
    pieces = pieces.withColumn("parts", parted).withColumn("piece", piece).drop("v")
    small = pieces.filter("parts = 1").withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards))).select("shard", "twice", "n", "first", "windows", "data")
    span = "n long, start int, end int"

    def spans(rows: list[tuple[int, int, int]]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["n", "start", "end"])

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t[name].combine_chunks().to_numpy(zero_copy_only=False)

    def solve(t: pa.Table) -> pa.Table:
        windows, twice = column(t, "windows").astype(np.int64), column(t, "twice").astype(bool)
        shard = Stretches(t["data"].to_pylist(), windows, twice)
        return spans(_marked(shard, column(t, "n"), column(t, "first"), windows, ~twice))

    def solve_pair(t: pa.Table) -> pa.Table:
        side = column(t, "piece")
        halves = []
        for p in sorted(set(side.tolist())):
            own = t.filter(pa.array(side == p))
            windows, twice = column(own, "windows").astype(np.int64), column(own, "twice").astype(bool)
            halves.append((Stretches(own["data"].to_pylist(), windows, twice), column(own, "n"), column(own, "first"), windows, ~twice))
        if len(halves) == 2:
            halves[0][0].merge(halves[1][0])
        return spans([s for h in halves for s in _marked(*h)])

    marked = small.groupBy("shard").applyInArrow(solve, span)
    large = pieces.filter("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select("hash", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "twice", "n", "first", "windows", "data")
    marked = marked.unionByName(large.groupBy("hash", "i", "j").applyInArrow(solve_pair, span))

    covered = materialize(whole.unionByName(marked), "covered").groupBy("n").agg(F.collect_list(F.struct("start", "end")).alias("list"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, data, found in zip(batch["n"].to_pylist(), batch["data"].to_pylist(), batch["list"].to_pylist()):
                kept, at, removed, runs = [], -1, 0, 0
                for start, end in sorted((s["start"], s["end"]) for s in found):
                    if start > at:
                        kept.append(data[max(at, 0) : start])
                        runs += 1
                        removed += end - start
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                kept.append(data[max(at, 0) :])
                rows.append((n, removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["n", "removed", "runs", "kept"])

    results = texts.filter("copies = 1").select("n", "data").join(covered, "n").select("n", "data", "list").mapInArrow(remove, "n long, removed long, runs long, kept string")
    results = nodes.select("key", "n", "copies").join(materialize(results, "removed"), "n", "left").drop("n")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    out = materialize(base.join(results, "key").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    ), "removals")
    drop()
    for used in (found, several, shared, kinds, variety, work):
        discard(used)
    return out


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its bytes, the bytes and runs removed as repeated, and a digest of the bytes that remain."""
    return removals(table(spark, sf_dir, "documents"))
