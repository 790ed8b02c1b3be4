"""MinHash near-dedup with ProbMinHash: shingles, banding, verification, classes.

A text's shingles are five consecutive words in lower case (a shorter text is one shingle). Every shingle is a Poisson process
whose rate is its weight: its arrivals fall into the registers at random, each register keeps its earliest arrival, and a
shingle stops as soon as its next arrival is later than all registers of the text. Registers agree with the probability Jaccard
similarity of the weighted sets. Distinct shingles all weigh 1 however often they occur, so that this is the Jaccard
similarity that is verified. BANDS bands of ROWS registers select candidates: a pair at 0.8 is missed with probability 6e-5.

Equal texts are one node from the start (and one row per task before any shuffle). In a bucket the nodes are not paired with
each other: a hub is compared with all of them, the nodes it does not reach become hubs in later rounds (up to HUBS a bucket
and round), and a bucket ends when all nodes that have not been hubs are in one class. So every pair of different classes has
been compared through one of its nodes being a hub, or is proven apart: in a bucket of more than LARGE nodes, two texts whose
shingles that any other node has are too few for NEAR cannot be alike, and are not met. Comparisons use the exact Jaccard
similarity of the distinct shingles; from NEAR on, two nodes are linked. Classes are the connected components of the
links, found by hooking to the least neighbour and pointer jumping on tables; every round joins the classes so far by its new
links only. What grows with a round (classes, hubs that were tried) is written and read again, so no plan grows with the rounds;
a hub, bucket, class or text with many rows is dealt out over several tasks.

Defined cases: null and empty texts are alike and form one class; null doc_ids are kept and never name a class that has another
id; repeated rows share a class; an empty table gives an empty result; extra columns are kept by `keep_one` and not read
otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE, bucketed, discard, materialize, table

BANDS, ROWS, LARGE, HUBS = 32, 6, 32, 256
#: Ways that a key with many rows is dealt out; pairs of a hub and nodes of a bucket that one task takes.
SALTS, CROWD, NODES = 16, 1024, 1 << 16
WORD = re.compile(r"\w+")
GOLDEN, CACHE = np.uint64(0x9E3779B97F4A7C15), 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Hashes of the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """A hash for each shingle of the text, repeated ones included."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in found], np.uint64)
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out * GOLDEN + h[j : len(h) - n + 1 + j])
    return out


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures (docs, m) of weighted sets given as flat, equally long arrays; rows of documents without elements stay 0."""
    time = np.full(docs * m, np.inf)
    owner = np.zeros(docs * m, np.uint64)
    latest = np.full(docs, np.inf)
    live, at, k = np.arange(len(element)), np.zeros(len(element)), 0
    while len(live):
        block = max(1, min(64, 16384 // len(live)))
        draw = mix(element[live][:, None] + np.arange(k + 1, k + block + 1, dtype=np.uint64)[None, :] * GOLDEN)
        gap = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[live][:, None]
        arrival = at[:, None] + np.cumsum(gap, axis=1)
        slot = (doc[live] * m)[:, None] + (mix(draw ^ GOLDEN) % np.uint64(m)).astype(np.int64)
        early = arrival <= latest[doc[live]][:, None]
        a, s = arrival[early], slot[early]
        np.minimum.at(time, s, a)
        won = time[s] == a
        owner[s[won]] = np.broadcast_to(element[live][:, None], arrival.shape)[early][won]
        latest = time.reshape(docs, m).max(1)
        stay = arrival[:, -1] <= latest[doc[live]]
        live, at, k = live[stay], arrival[stay, -1], k + block
    return owner.reshape(docs, m)


def bands_of(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        out = mix(out * GOLDEN + parts[:, :, j])
    return out.view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (digest of the text), bands of every document; null bands if it has no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part["text"].to_pylist()
                nodes = [hashlib.md5((t or "").encode()).digest() for t in texts]
                place, first = {}, []
                for t, key in enumerate(nodes):
                    if key not in place:
                        place[key] = len(first)
                        first.append(t)
                sets = [np.unique(shingles(texts[t], hashes)) for t in first]
                size = [len(s) for s in sets]
                element = np.concatenate(sets)
                signature = prob_min_hash(np.repeat(np.arange(len(sets)), size), element, np.ones(len(element)), len(sets), bands * rows)
                hashed = bands_of(signature, rows)
                out = [hashed[place[key]] if size[place[key]] else None for key in nodes]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(nodes, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, shingles: the distinct shingles of each text (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [np.unique(shingles(t, hashes)).view(np.int64) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def look_up(rows: DataFrame, key: str, mapping: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with mapping (one row a key) where one key may hold a third of all rows: each key is dealt out SALTS ways by
    `spread`, and what the mapping says of it goes once to each of them."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    told = salted.select(key, "_salt").distinct().join(mapping.hint("merge"), key)
    return salted.join(told.hint("merge"), [key, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of the connected component, for every node of links (a, b). Every round takes the least label
    around a node and then that label's own label, until none changes."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = look_up(edges, "b", labels.select(F.col("node").alias("b"), "label"), "a").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        above = labels.select(F.col("node").alias("new"), F.col("label").alias("top"))
        moved = materialize(look_up(hooked, "new", above, "node").select("node", F.least("new", "top").alias("label"), (F.least("new", "top") != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            discard(edges)
            return labels


def linkable(buckets: DataFrame, sets: DataFrame, near: float) -> DataFrame:
    """bucket, node, company, ways, n, shared: n shingles, of which `shared` occur in another node of a large bucket as well (all, in
    small buckets). Two nodes can only be alike if both share enough; a node that shares too little for any partner goes. That
    is what keeps a thousand copies with edits of their own from being compared with each other."""
    sized = buckets.join(sets.select("node", F.size("shingles").alias("n")), "node")
    large = sized.filter(F.col("size") > LARGE)
    inside = large.select("node").distinct()
    spread = sets.join(inside, "node").select("node", F.explode("shingles").alias("h"))
    common = spread.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    shared = materialize(spread.join(common, "h").groupBy("node").agg(F.count("*").alias("shared")), "shared")
    judged = large.join(shared, "node", "left").withColumn("shared", F.coalesce("shared", F.lit(0))).filter(F.col("shared") >= near * F.col("n"))
    small = sized.filter(F.col("size") <= LARGE).withColumn("shared", F.col("n").cast("long"))
    return small.unionByName(judged).withColumn("ways", F.ceil(F.col("size") / NODES).cast("int")).drop("size")


def node_of(text: str = "text") -> Column:
    """The text's node, as `signed` names it."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def grouped(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every document, and node, rep (its least doc_id), label (of its class), class_id, class_size of every node."""
    members = materialize(signed(docs, bands, rows), "signed")
    nodes = materialize(members.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
    placed = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(placed.join(shared, "bucket"), "buckets")
    # the more company a node has in its buckets, the likelier it is the text that others were copied from
    rank = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    needed = rank.select("node").join(nodes.select("node", "rep"), "node")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").withColumn("node", node_of())
    # a repeated row of the least doc_id gives its node twice, which only repeats pairs and weakens `linkable`
    chosen = texts.withColumnRenamed("rep", "doc_id").join(needed, "node").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    sets, drop = bucketed(shingle_sets(chosen.select("node", "text")), "node")
    placed = buckets
    buckets = materialize(linkable(placed.join(rank, "node"), sets, near), "linkable")
    discard(placed)

    # every node is its own class at first; the classes, and which nodes have been hubs, are written anew in each round
    labels = materialize(buckets.select("node", F.col("node").alias("label")).distinct(), "classes")
    tried, hubs = None, 1
    while True:
        state = buckets.join(labels.hint("merge"), "node")
        if tried is not None:
            state = state.join(tried.hint("merge"), ["bucket", "node"], "left")
        else:
            state = state.withColumn("tried", F.lit(None).cast("boolean"))
        # open: nodes that were no hubs; a bucket with open nodes in two classes or more goes on, at its largest class first
        groups = state.filter("tried is null").groupBy("bucket", "label").agg(F.count("*").alias("n_open"), F.max(F.struct("company", "node")).alias("best"))
        going = groups.groupBy("bucket").agg(F.count("*").alias("labels"), F.max("best")["node"].alias("top"), F.max(F.struct("n_open", "label"))["label"].alias("main")).filter("labels > 1")
        if tried is None:  # first the node with most company
            chosen = going.select("bucket", F.col("top").alias("hub"))
        else:  # then nodes outside the bucket's largest class, `hubs` a bucket at most
            outside = state.filter("tried is null").join(going.select("bucket", "main").hint("merge"), "bucket").filter("label != main")
            order = Window.partitionBy("bucket").orderBy(F.desc("company"), "node")
            chosen = outside.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= hubs).select("bucket", F.col("node").alias("hub"))
        chosen = materialize(chosen, "hubs")
        if chosen.isEmpty():
            break
        # a bucket's hubs come to its nodes as one list, and a node's lists become one, so that a pair is made once however many buckets it shares
        about = state.select("bucket", F.col("node").alias("hub"), "ways", F.struct("node", "label", "n", "shared", "company").alias("of"))
        lists = chosen.join(about.hint("merge"), ["bucket", "hub"]).groupBy("bucket", "ways").agg(F.collect_set("of").alias("hubs"))
        lists = lists.select("bucket", "hubs", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
        likely = lambda h: (h["label"] != F.col("label")) & (F.least(F.col("shared"), h["shared"]) * (1 + near) >= near * (F.col("n") + h["n"]))
        met = state.withColumn("way", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")).join(lists.hint("merge"), ["bucket", "way"])
        met = met.select("node", F.transform(F.filter("hubs", likely), lambda h: F.struct(h["node"].alias("b"), h["company"].alias("company"))).alias("hubs")).filter(F.size("hubs") > 0)
        pairs = met.groupBy(F.col("node").alias("a")).agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs")).select("a", F.inline("hubs"))
        pairs = materialize(pairs, "pairs")
        own, others = (sets.select(F.col("node").alias(x), F.col("shingles").alias(y)) for x, y in (("a", "x"), ("b", "y")))
        # a hub has at most `company` pairs: those of one with many are dealt out over several tasks, and its shingles go to each
        few = pairs.filter(F.col("company") <= CROWD).join(own, "a").join(others, "b").select("a", "b", "x", "y")
        many = pairs.filter(F.col("company") > CROWD).withColumn("ways", F.ceil(F.col("company") / CROWD).cast("int"))
        shown = many.select("b", "ways").distinct().join(others, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
        many = many.join(own, "a").withColumn("way", F.pmod(F.xxhash64("a"), F.col("ways")).cast("int")).join(shown, ["b", "way"]).select("a", "b", "x", "y")
        common = few.unionByName(many).select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))
        linked = common.filter(F.col("both") >= near * (F.col("nx") + F.col("ny") - F.col("both")))
        links = materialize(linked.select("a", "b"), "links")
        discard(pairs)
        if not links.isEmpty():
            # only classes that a new link joins change: components of the classes, not of all links again
            of = labels.withColumnRenamed("node", "b")
            between = look_up(links.join(labels.withColumnRenamed("node", "a").withColumnRenamed("label", "la").hint("merge"), "a"), "b", of.withColumnRenamed("label", "lb"), "a")
            merged = components(between.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            moved = look_up(labels, "label", merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "node", "left")
            renewed = materialize(moved.select("node", F.coalesce("to", "label").alias("label")), "classes")
            discard(labels)
            discard(merged)
            labels = renewed
        discard(links)
        done = chosen.select("bucket", F.col("hub").alias("node"), F.lit(True).alias("tried"))
        so_far = done if tried is None else materialize(tried.unionByName(done), "tried")
        if tried is not None:
            discard(tried)
            discard(chosen)
        tried, hubs = so_far, HUBS
    drop()
    discard(buckets)
    known = nodes.select("node", "rep", "copies").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = known.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    return members.select("doc_id", "node"), look_up(known.select("node", "rep", "label"), "label", names, "node")


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, near: float = NEAR) -> DataFrame:
    """doc_id, class_id, class_size of every document: class_id is the least doc_id of its class, class_size its number of documents."""
    members, named = grouped(docs, bands, rows, near)
    named = materialize(named.select("node", "class_id", "class_size"), "named")
    return look_up(members, "node", named, "doc_id").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: the one with the least doc_id (null comes last), of several texts under
    that doc_id the one with the least digest; of repeated rows of it one stays."""
    _, named = grouped(docs)
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "node")).alias("head"))
    # plain equalities on the same three columns, so that the rows are dealt out once
    heads = heads.select("head.node", "head.unnamed", F.coalesce("head.rep", F.lit(0)).alias("known"))
    rows = docs.select(node_of().alias("node"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("known"), F.struct(*docs.columns).alias("row"))
    return rows.join(heads, ["node", "unnamed", "known"]).dropDuplicates(["node", "unnamed", "known"]).select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its class of exact and near duplicates and the class's size."""
    return classes(table(spark, sf_dir, "documents"))
