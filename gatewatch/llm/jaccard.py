"""N-gram Jaccard join: universe partition by the pigeonhole principle, one-deletion neighbourhoods, exact verification.

A text's set holds its distinct shingles of three words (a shorter text is one shingle). Two sets of a and b shingles link when
100 * common >= PERCENT * union; they then differ in (a + b) * (100 - PERCENT) / (100 + PERCENT) shingles at most. Sizes fall into bands
so narrow that the larger set of a link lies in the smaller one's band or in the next. For each band, hashing cuts the universe
of shingles, and so each set, into segments; if H is the most in which two such sets can differ, then of m0 segments that must be
equal and m1 that may differ by one shingle, m0 + 2 * m1 > H, one must match. Sets that agree on a segment are met under the hash of its
subset, those that differ by one under a subset that one of them has and the other has but for one shingle. How many
segments are of which kind follows from what it costs, by the number of sets in the band: signatures written, and pairs that
meet by chance. The costs decide about speed alone: no link is lost under any choice.

Equal sets are one node from the start. Nodes under one signature are not paired with each other: a hub is compared with all
of them, those not yet in the class of most become hubs later (HUBS a signature and round), until all nodes that were no hub are
in one class. Under a signature of more than LARGE nodes, those that share too few of their shingles with any other are not met, which
proves them apart. Comparisons use all shingles. So any two nodes that share a signature are compared, proven apart, or in one
component already.

Equality of shingles and sets rests on 64-bit and 128-bit hashes, numbers are whole. Defined cases: null and empty texts, and texts of
separators only, have an empty set and link with nothing; null doc_ids are rows like others and name no component that has another
id (a component of theirs alone has null); repeated rows, and different texts under one doc_id, each have their own row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, table
from .neardup import components, look_up
from .tokens import GOLDEN, kinds, mix, parts, words_of

WORDS, PERCENT, HUBS, LARGE, PEELS = 3, 90, 256, 32, 3
SEPARATORS = kinds(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of text that a task works on at once.
PART = 4 << 20
#: What one compared pair costs in signatures written, and the bytes of a word, for choosing segments only.
PAIR, WORD_BYTES = 50, 6.5

Batches = Iterator[pa.RecordBatch]


@dataclass
class Bands:
    """Sizes `low[j]` to `low[j + 1] - 1` are band j. Sets of the bands j and j + 1 meet under band j's cut: `equal[j]` segments that must
    be equal after `near[j]` that may differ by one; none where only equal sets can link."""

    low: np.ndarray
    equal: np.ndarray
    near: np.ndarray

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1


def most_different(a: int, b: int, percent: int) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def allocation(size: int, most: int, sets: float) -> tuple[int, int]:
    """(equal, near) segments for sets of `size` that differ in `most` at most: the cheapest of several shares of either kind."""

    def cost(equal: int, near: int) -> float:
        mean = size / (equal + near)
        written = equal + near * (1 + mean)
        by_chance = math.exp(-2 * mean) * (equal + near * (1 + 2 * mean))  # two unlike sets agree where both have next to nothing
        return sets * written + PAIR * sets * sets / 2 * by_chance

    options = {max(0, math.ceil((most + 1) * share / 2)) for share in (0, 1 / 8, 1 / 4, 1 / 2, 1)}
    return min(((max(0, most + 1 - 2 * near), near) for near in options), key=lambda x: (cost(*x), x[1]))


def bands(sizes: dict[int, int], percent: int = PERCENT, longest: int | None = None) -> Bands:
    """The bands, given about how many sets there are of about which size."""
    longest = longest or 1 << 40
    low, equal, near = [1], [], []
    while low[-1] <= longest:
        low.append(low[-1] * 100 // percent + 1)
    about = np.array(sorted(sizes)) if sizes else np.zeros(0, np.int64)
    band = np.searchsorted(low, about, "right") - 1
    number = np.bincount(band, [sizes[int(s)] for s in about], minlength=len(low) + 1) if len(about) else np.zeros(len(low) + 1)
    for j in range(len(low) - 1):
        top = low[j + 1] - 1
        most = most_different(top, top * 100 // percent, percent)
        e, n = allocation(top, most, max(1.0, number[j] + number[j + 1])) if most else (0, 0)
        equal.append(e)
        near.append(n)
    return Bands(np.array(low), np.array([*equal, 0]), np.array([*near, 0]))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending."""
    words = words_of(texts, SEPARATORS)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.words.to_pylist()], np.uint64)
    h, counts = hashes[words.code] if len(hashes) else np.zeros(0, np.uint64), np.bincount(words.text, minlength=len(texts))
    out = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for j in range(width):
        out = mix(out * GOLDEN + h[j : j + len(out)])
    ends = np.cumsum(counts)
    found = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            found.append(np.unique(out[end - n : end - width + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for w in h[end - n : end]:
                x = mix(x * GOLDEN + w)
            found.append(x)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signatures(sets: list[np.ndarray], cut: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets, as two arrays in the order of the sets."""
    size = np.array([len(s) for s in sets], np.int64)
    element, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
    own = cut.of(np.maximum(size, 1))
    whose, what = [], []
    for back in (0, 1):
        band = own - back
        equal, near = (np.where((band >= 0) & (size > 0), x[np.maximum(band, 0)], 0) for x in (cut.equal, cut.near))
        segments = equal + near
        inside = segments[owner] > 0
        e, o = element[inside], owner[inside]
        if not len(e):
            continue
        first = np.cumsum(segments) - segments
        which = (mix(e + band[o].astype(np.uint64) * GOLDEN) % segments[o].astype(np.uint64)).astype(np.int64)
        at, token = first[o] + which, mix(e ^ GOLDEN)
        value = np.zeros(int(segments.sum()), np.uint64)
        np.add.at(value, at, token)  # a subset is the sum of its elements' hashes
        of = np.repeat(np.arange(len(sets)), segments)
        number = np.arange(len(of)) - first[of]
        salt = mix((band[of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1))
        whose.append(of)
        what.append(mix(value ^ salt))
        loose = which < near[o]
        whose.append(o[loose])
        what.append(mix((value[at[loose]] - token[loose]) ^ salt[at[loose]]))
    if not whose:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whose, what = np.concatenate(whose), np.concatenate(what)
    order = np.argsort(whose, kind="stable")
    return whose[order], what[order]


def signed(docs: DataFrame, cut: Bands, width: int = WORDS) -> DataFrame:
    """doc_id, key (digest of the text), node (digest of the set, null if empty), n, signatures of every document; equal sets in one
    part have them once."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, to in parts(batch["text"], PART):
                part = batch.slice(at, to - at)
                coded = part["text"].dictionary_encode()
                sets = shingle_sets(coded.dictionary, width)
                digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                place = {d: i for i, d in reversed([*enumerate(digests)]) if d}
                chosen = sorted(place.values())
                whose, what = signatures([sets[i] for i in chosen], cut)
                ends = np.searchsorted(whose, np.arange(len(chosen)), "right")
                lists = {i: what[(ends[k - 1] if k else 0) : ends[k]].view(np.int64) for k, i in enumerate(chosen)}
                codes = coded.indices.to_pylist()
                rows = [lists.pop(c, None) for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["key"], pa.array([None if c is None else digests[c] for c in codes], pa.binary()), pa.array([0 if c is None else len(sets[c]) for c in codes], pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                    ["doc_id", "key", "node", "n", "signatures"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key binary, node binary, n long, signatures array<long>")


def sets_of(texts: DataFrame, width: int = WORDS) -> DataFrame:
    """node, shingles of (node, text)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, to in parts(batch["text"], PART):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([s.view(np.int64) for s in shingle_sets(part["text"], width)], pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. b, a hub, may have very many pairs: they are dealt out."""
    own, others = (sets.select(F.col("node").alias(x), F.col("shingles").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    both = look_up(pairs, "b", others, "a").join(own, "a")
    counted = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return counted.filter(F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def linkable(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """bucket, node, n, company, shared: of a node's n shingles `shared` occur in another node of a large bucket, too; all, in small
    buckets. What two nodes have in common both of them share; a node that shares too little to link with any of its bucket goes,
    and what only such nodes shared counts no more (PEELS times). So copies with edits of their own are not compared with each other."""
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    placed = buckets.join(company, "node")
    large = placed.filter(F.col("size") > LARGE)
    alive = large.select("node").distinct()
    for _ in range(PEELS):
        spread = sets.join(alive, "node").select("node", F.explode("shingles").alias("h"))
        common = spread.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
        shared = spread.join(common, "h").groupBy("node").agg(F.count("*").alias("shared"))
        # the other one of a link has `least` shingles at least, and percent of this one's
        other = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100))
        judged = materialize(large.drop("shared").join(shared, "node").filter(F.col("shared") * (100 + percent) >= percent * (F.col("n") + other)), "judged")
        large, alive = judged, judged.select("node").distinct()
    return placed.filter(F.col("size") <= LARGE).withColumn("shared", F.col("n")).unionByName(large).drop("size", "least")


def connected(buckets: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label of the nodes of buckets (bucket, node, n, size, least): the label is the same for linked nodes."""
    placed = materialize(linkable(buckets, sets, percent), "placed")
    labels = materialize(placed.select("node", F.col("node").alias("label")).distinct(), "classes")
    tried, first = None, True
    while True:
        state = placed.join(labels.hint("merge"), "node")
        state = state.withColumn("tried", F.lit(False)) if tried is None else state.join(tried.hint("merge"), ["bucket", "node"], "left").withColumn("tried", F.col("tried").isNotNull())
        groups = state.filter("not tried").groupBy("bucket", "label").agg(F.count("*").alias("open"), F.max(F.struct("company", "node")).alias("best"))
        going = groups.groupBy("bucket").agg(F.count("*").alias("labels"), F.max("best").alias("best"), F.max(F.struct("open", "label"))["label"].alias("main")).filter("labels > 1")
        if first:  # the node in most company is likely the one that the others come from
            hubs = going.select("bucket", F.col("best.node").alias("b"))
        else:
            outside = state.filter("not tried").join(going.select("bucket", "main").hint("merge"), "bucket").filter("label != main")
            ranked = outside.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("company"), "node")))
            hubs = ranked.filter(F.col("rank") <= HUBS).select("bucket", F.col("node").alias("b"))
        hubs = materialize(hubs, "hubs")
        if hubs.isEmpty():
            return labels
        about = state.select("bucket", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bs"), F.col("label").alias("to"))
        lists = hubs.join(about.hint("merge"), ["bucket", "b"]).groupBy("bucket").agg(F.collect_list(F.struct("b", "bn", "bs", "to")).alias("hubs"))  # HUBS at most
        alike = lambda h: (100 * F.least(h["bn"], F.col("n")) >= percent * F.greatest(h["bn"], F.col("n"))) & ((100 + percent) * F.least(h["bs"], F.col("shared")) >= percent * (h["bn"] + F.col("n")))
        fits = lambda h: (h["to"] != F.col("label")) & alike(h)
        met = look_up(state.select("bucket", "node", "n", "shared", "label"), "bucket", lists, "node")
        pairs = met.select(F.col("node").alias("a"), F.explode(F.filter("hubs", fits)).alias("h")).select("a", F.col("h.b").alias("b")).distinct()
        links = materialize(verified(pairs, sets, percent), "links")
        if not links.isEmpty():
            of = lambda x, y: labels.select(F.col("node").alias(x), F.col("label").alias(y))
            between = look_up(links.join(of("a", "la").hint("merge"), "a"), "b", of("b", "lb"), "a").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            merged = components(between)
            moved = look_up(labels, "label", merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "node", "left")
            renewed = materialize(moved.select("node", F.coalesce("to", "label").alias("label")), "classes")
            discard(labels)
            labels = renewed
        discard(links)
        done = hubs.select("bucket", F.col("b").alias("node"), F.lit(True).alias("tried"))
        tried = materialize(done if tried is None else tried.unionByName(done), "tried")
        first = False


def joined(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, cut: Bands | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    if cut is None:
        about = F.greatest(F.lit(1), F.round(F.exp(F.floor(F.log(F.octet_length("text") / WORD_BYTES) * 20) / 20))).cast("long")
        cut = bands({r["size"]: r["count"] for r in docs.filter(F.length("text") > 0).groupBy(about.alias("size")).count().collect()}, percent)  # a few hundred rows
    whole = materialize(signed(docs, cut, width), "signed")
    members = materialize(whole.drop("signatures"), "members")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("rep")
    nodes = materialize(members.filter("node is not null").groupBy("node").agg(best, F.first("n").alias("n")), "nodes")
    # equal sets of different parts come twice here: most signatures go before that is told apart
    placed = whole.filter("signatures is not null").select("node", F.explode(F.array_distinct("signatures")).alias("bucket"))
    often = placed.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1").select("bucket")
    met = materialize(placed.join(often, "bucket").distinct(), "met")
    discard(whole)
    met = met.join(nodes.select("node", "n"), "node")
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1")
    buckets = materialize(met.join(sizes, "bucket"), "buckets")
    needed = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.coalesce("rep.doc_id", F.lit(0)).alias("id"), F.col("rep.unnamed").alias("unnamed"), F.col("rep.key").alias("key"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    chosen = texts.join(needed.hint("merge"), ["id", "unnamed", "key"])
    sets, drop = bucketed(sets_of(chosen, width).dropDuplicates(["node"]), "node")  # repeated rows of a document are one
    labels = connected(buckets, sets, percent)
    drop()
    discard(buckets)
    known = nodes.select("node", F.col("rep.doc_id").alias("rep")).join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(look_up(known, "label", known.groupBy("label").agg(F.min("rep").alias("component_id")), "node").select("node", "component_id"), "named")
    alone = members.filter("node is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = look_up(members.filter("node is not null").select("doc_id", "node", "n"), "node", named, "doc_id")
    return rest.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its shingles and the component of its links."""
    return joined(table(spark, sf_dir, "documents"))
