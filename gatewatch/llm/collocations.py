"""Phrase collocation mining: minimal perfect hashes over Apriori-safe candidates, counts by slot.

A phrase of k words is a pair: the slot of its first k - 1 words and the slot of its last k - 1, so that only phrases whose parts are
frequent are ever looked at (Apriori), whatever their length. On each level a sieve finds the candidates: pairs whose hash occurs LEAST times, and
of these the pairs that do so themselves. The candidates are dealt into blocks by a hash; each block gets a
minimal perfect hash and keeps its keys in the order of the slots. Mappers look every pair up, compare the stored key, and count
slots with bincount; their arrays are added up in a tree, block by block. Slots also replace the pairs in the texts, which makes the
next level's input. All counts that a result needs (parts, cuts, longer phrases) are read by slot.

A mapper holds a part of the texts and the blocks (BLOCK candidates each) it used lately, KEEP at most; with more blocks it reads
them again for each part. Nothing grows in the driver.

Counts are per language, a null one being `und`; words end at spaces and tabs, pieces at .,;:!? and line breaks; A-Z are lower-cased.
Defined cases: null and empty texts have no words; languages without candidates have no rows; ties in the score go by the count, then the
phrase in byte order; repeated rows count as often as they occur; a text is worked on in one piece, whatever its length;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table
from .mph import PerfectHash
from .tokens import GOLDEN, Words, kinds, mix, parts, words_of

LEAST, LONGEST, LIMIT, SUBSUMED = 30, 4, 2000, 80
SEPARATORS = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
#: Candidates of a block, slot numbers set aside for one, and blocks that a mapper holds.
BLOCK, STRIDE, KEEP = 1 << 18, 1 << 20, 64
#: Bytes of text that a mapper works on at once, parts whose arrays one addition takes, and ways a language's ranking is dealt out.
PART, FAN, SALTS = 4 << 20, 16, 64
#: Slots of a row of a sequence; hashes of pairs have 32 bits and are counted in ranges of 2^SHIFT.
RUN, SHIFT = 1 << 17, 23
RANGES = 1 << 32 - SHIFT

Batches = Iterator[pa.RecordBatch]
SEQUENCES = "block long, part long, data binary"


def row(block: int, part: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([data.tobytes()], pa.binary())], ["block", "part", "data"])


def by_language(batches: Batches, size: int) -> Iterator[tuple[str, Words]]:
    """The words of each part of the texts and each language in it."""
    for batch in batches:
        for at, to in parts(batch["text"], size):
            part = batch.slice(at, to - at)
            langs = part["lang"].dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, words_of(part["text"].filter(pa.array(langs.indices.to_numpy() == code)), SEPARATORS)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64) * GOLDEN) + b.view(np.uint64))


def word_keys(words: pa.Array, lang: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Key (a word has no tab), hash and block hash of each word of a language."""
    end = b"\t" + lang.encode()
    keys = [w + end for w in words.to_pylist()]
    return keys, np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys)), np.fromiter((zlib.crc32(k) for k in keys), np.int64, len(keys))


def pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(pair_hash(a, b)) >> np.uint64(32)).astype(np.int64)


class Blocks:
    """Reads blocks of a table that lies in the shared folder, one folder a block, and holds the last KEEP of them."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        self.path, self.keep, self.held = path, keep, {}

    def __getitem__(self, block: int) -> dict | None:
        if block not in self.held:
            while len(self.held) >= self.keep:
                del self.held[next(iter(self.held))]
            self.held[block] = self.read(block)
        return self.held[block]

    def read(self, block: int) -> dict | None:
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/block={block}"
        if store.get_file_info(folder).type == fs.FileType.NotFound:
            return None
        found = ds.dataset(folder, filesystem=store, format="parquet").to_table().to_pylist()[0]
        out = {k: np.frombuffer(found[k], np.int64) for k in ("a", "b", "counts") if found.get(k) is not None}
        if "hot" in found:
            out["hot"] = np.frombuffer(found["hot"], np.uint32)
        if "bits" in found:
            out["hash"] = PerfectHash(np.frombuffer(found["sizes"], np.int64), np.frombuffer(found["bits"], np.uint64))
            out["keys"] = pa.array(found["keys"] or [], pa.binary())
            out["n"] = found["n"]
        return out

    def find(self, hashes: np.ndarray, place: np.ndarray, number: int, same) -> np.ndarray:
        """The slot of each key, -1 if it is none. same(block, slots, which): whether the stored keys are those asked for."""
        out, block = np.full(len(hashes), -1, np.int64), place % max(1, number)
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(number), "right")
        for k in range(number):
            which = order[ends[k - 1] if k else 0 : ends[k]]
            held = self[k] if len(which) else None
            if held is None:
                continue
            slots = held["hash"].slots(hashes[which])
            known = slots >= 0
            right = np.zeros(len(which), bool)
            right[known] = same(held, slots[known], which[known])
            out[which[right]] = slots[right] + k * STRIDE
            for extra in range(held["hash"].placed, held["n"]):  # keys of equal hash lie behind the others
                equal = same(held, np.full(len(which), extra), which)
                out[which[equal]] = extra + k * STRIDE
        return out

    def take(self, name: str, slots: np.ndarray) -> np.ndarray:
        """What the array `name` has at each slot."""
        out, block = np.zeros(len(slots), np.int64), slots // STRIDE
        for k in np.unique(block).tolist():
            at = block == k
            out[at] = self[k][name][slots[at] % STRIDE]
        return out

    def words(self, slots: np.ndarray) -> list[bytes]:
        out, block = [b""] * len(slots), slots // STRIDE
        for k in np.unique(block).tolist():
            at = np.flatnonzero(block == k)
            for i, w in zip(at.tolist(), self[k]["keys"].take(pa.array(slots[at] % STRIDE)).to_pylist(), strict=True):
                out[i] = w
        return out


def same_pair(a: np.ndarray, b: np.ndarray):
    return lambda held, slots, which: (held["a"][slots] == a[which]) & (held["b"][slots] == b[which])


def same_word(keys: pa.Array):
    return lambda held, slots, which: np.asarray(pc.equal(held["keys"].take(pa.array(slots)), keys.take(pa.array(which))))


def uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as pyarrow reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def written(df: DataFrame, name: str) -> str:
    """Writes a table with a row a block into the shared folder, one folder a block, and returns its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy("block").parquet(path)
    return uri(df.sparkSession, path)


def index(candidates: DataFrame, level: int, block: int) -> tuple[str, int]:
    """Writes the blocks of a level's candidates, (key) of words or (a, b) of pairs: perfect hash and stored keys. Returns the path and
    the number of blocks."""
    number = -(-candidates.count() // block)
    fields = ["key"] if level == 1 else ["a", "b"]

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            if level == 1:
                keys = batch["key"].to_pylist()
                h, place = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys)), np.fromiter((zlib.crc32(k) for k in keys), np.int64, len(keys))
            else:
                a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
                h, place = pair_hash(a, b), pair_place(a, b)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in fields), pa.array(h.view(np.int64)), pa.array(place % number)], [*fields, "h", "block"])

    def build(rows: pa.Table) -> pa.Table:
        h = rows["h"].to_numpy().view(np.uint64)
        perfect = PerfectHash.build(h)
        slots = perfect.slots(h)
        # a hash that occurs twice has no slot of its own; that a foreign bit gives it one is as good as none
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        slots[times[which] > 1] = -1
        slots[slots < 0] = np.arange(perfect.placed, perfect.placed + (slots < 0).sum())
        if len(h) > STRIDE:
            raise ValueError("a block has more candidates than slot numbers")
        order = np.argsort(slots)
        stored = {c: rows[c].to_numpy()[order].tobytes() for c in fields} if level > 1 else {"a": None, "b": None}
        keys = rows["key"].combine_chunks().take(pa.array(order)).to_pylist() if level == 1 else None
        return pa.table({"block": [rows["block"][0].as_py()], "n": [len(h)], "sizes": [perfect.sizes.tobytes()], "bits": [perfect.words.tobytes()], "keys": pa.array([keys], pa.list_(pa.binary())), "a": pa.array([stored["a"]], pa.binary()), "b": pa.array([stored["b"]], pa.binary())})

    dealt = candidates.mapInArrow(deal, ("key binary" if level == 1 else "a long, b long") + ", h long, block long")
    blocks = dealt.groupBy("block").applyInArrow(build, "block long, n long, sizes binary, bits binary, keys array<binary>, a binary, b binary")
    return written(blocks, f"index{level}"), number


class Counter:
    """A mapper's counts by slot; yields the arrays when there are many, and at its end."""

    def __init__(self, blocks: Blocks) -> None:
        self.blocks, self.counts, self.task = blocks, {}, TaskContext.get().partitionId()

    def add(self, slots: np.ndarray) -> Batches:
        block = slots // STRIDE
        for k in np.unique(block).tolist():
            n = self.blocks[k]["n"]
            found = np.bincount(slots[block == k] % STRIDE, minlength=n)
            self.counts[k] = self.counts[k] + found if k in self.counts else found
        if len(self.counts) > self.blocks.keep:
            yield from self.flush()

    def flush(self) -> Batches:
        for k, counts in self.counts.items():
            yield row(k, self.task, counts.astype(np.int64))
        self.counts = {}


def runs(slots: np.ndarray, kind: type, size: int = RUN) -> Batches:
    """Rows of the sequence without what no phrase can hold: of several -1 one is kept, and slots without a neighbour go. Rows end at the
    first -1 after `size` slots, so no phrase is cut."""
    known = slots >= 0
    left, right = np.concatenate([[False], known[:-1]]), np.concatenate([known[1:], [False]])
    kept = slots[(known & (left | right)) | (~known & left)].astype(kind)
    ends, at = np.append(np.flatnonzero(kept < 0), len(kept)), 0
    while at < len(kept):
        to = int(ends[min(np.searchsorted(ends, at + size), len(ends) - 1)])
        if to - at > 1:
            yield row(-1, 0, kept[at:to])
        at = to + 1


def slot_type(number: int) -> type:
    """What holds the slots of so many blocks."""
    return np.int32 if number * STRIDE < 1 << 31 else np.int64


def sequences_of(df: DataFrame) -> DataFrame:
    """Writes and rereads rows of sequences and counts. They are not compressed, so that a task's share is what it holds in memory."""
    path = f"{shared_dir(df.sparkSession)}/sequences-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, path: str, number: int, part: int, keep: int) -> DataFrame:
    """Replaces words by their slots. Rows with block -1 hold sequences, in which -1 separates; the others a block's counts."""

    kind = slot_type(number)

    def run(batches: Batches) -> Batches:
        blocks = Blocks(path, keep)
        counter = Counter(blocks)
        for lang, words in by_language(batches, part):
            keys, hashes, place = word_keys(words.words, lang)
            slots = blocks.find(hashes, place, number, same_word(pa.array(keys, pa.binary())))[words.code] if len(keys) else np.zeros(0, np.int64)
            yield from counter.add(slots[slots >= 0])
            new = np.flatnonzero(np.diff(words.piece)) + 1
            yield from runs(np.insert(slots, new, -1), kind)
        yield from counter.flush()

    return docs.mapInArrow(run, SEQUENCES)


def lengthened(sequences: DataFrame, given: type, path: str, number: int, keep: int) -> DataFrame:
    """Replaces neighbouring slots, of type `given`, by the slot of both, as `numbered` does words."""
    kind = slot_type(number)

    def run(batches: Batches) -> Batches:
        blocks = Blocks(path, keep)
        counter = Counter(blocks)
        for batch in batches:
            for data in batch["data"]:
                s = np.frombuffer(data.as_buffer(), given).astype(np.int64)
                at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                a, b = s[at], s[at + 1]
                slots = np.full(max(0, len(s) - 1), -1, np.int64)
                slots[at] = blocks.find(pair_hash(a, b), pair_place(a, b), number, same_pair(a, b))
                yield from counter.add(slots[slots >= 0])
                yield from runs(slots, kind)
        yield from counter.flush()

    return sequences.select("data").mapInArrow(run, SEQUENCES)


def added_up(counts: DataFrame, fan: int) -> DataFrame:
    """block, counts: the mappers' arrays (block, part, data) added up in a tree, `fan` of them at a time."""

    def add(batches: Batches) -> Batches:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, data in zip(batch["block"].to_pylist(), batch["part"].to_pylist(), batch["data"], strict=True):
                x = np.frombuffer(data.as_buffer(), np.int64)
                sums[block, part] = sums[block, part] + x if (block, part) in sums else x
        for (block, part), x in sums.items():
            yield row(block, part, x)

    most = counts.agg(F.max("part")).first()[0] or 0
    while True:
        counts = counts.withColumn("part", F.expr(f"part div {fan}")).repartition("block", "part").mapInArrow(add, SEQUENCES)
        most //= fan
        if not most:
            return counts.select("block", F.col("data").alias("counts"))


def pairs_of(data: pa.Scalar, given: type) -> tuple[np.ndarray, np.ndarray]:
    """The neighbouring slots, of type `given`, of a sequence."""
    s = np.frombuffer(data.as_buffer(), given).astype(np.int64)
    both = (s[:-1] >= 0) & (s[1:] >= 0)
    return s[:-1][both], s[1:][both]


def frequent_hashes(sequences: DataFrame, given: type, least: int) -> DataFrame:
    """hashes: of neighbouring slots, in 32 bits, that occur `least` times; each range of the hashes is counted in one array. Pairs of
    equal hash count together, so no frequent pair is missed."""
    cuts = np.arange(1, RANGES) << SHIFT

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            for data in batch["data"]:
                h, n = np.unique(pair_place(*pairs_of(data, given)), return_counts=True)
                once = n == 1
                single, more, counts = h[once].astype(np.uint32), h[~once].astype(np.uint32), n[~once].astype(np.int32)
                parts_of = [np.split(x, np.searchsorted(x, cuts)) for x in (single, more)] + [np.split(counts, np.searchsorted(more, cuts))]
                some = [k for k in range(RANGES) if len(parts_of[0][k]) or len(parts_of[1][k])]
                columns = [pa.array([p[k].tobytes() for k in some], pa.binary()) for p in parts_of]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *columns], ["range", "single", "more", "counts"])

    def count(batches: Batches) -> Batches:
        now, total = None, np.zeros(1 << SHIFT, np.int64)

        def given_out() -> Batches:
            hot = np.flatnonzero(total >= least) + (now << SHIFT)
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.array([hot.astype(np.uint32).tobytes()], pa.binary())], ["hashes"])

        for batch in batches:
            for k, single, more, counts in zip(batch["range"].to_pylist(), batch["single"], batch["more"], batch["counts"], strict=True):
                if k != now:
                    if now is not None:
                        yield from given_out()
                    now = k
                    total[:] = 0
                total[np.frombuffer(single.as_buffer(), np.uint32) - (k << SHIFT)] += 1
                total[np.frombuffer(more.as_buffer(), np.uint32) - (k << SHIFT)] += np.frombuffer(counts.as_buffer(), np.int32)
        if now is not None:
            yield from given_out()

    dealt = sequences.select("data").mapInArrow(deal, "range long, single binary, more binary, counts binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(count, "hashes binary")


def sieve(sequences: DataFrame, given: type, least: int, block: int, keep: int) -> DataFrame:
    """a, b: neighbouring slots, of type `given`, that occur `least` times. First hashes are counted, in a few bytes each; then the pairs of
    frequent hashes, and these only, as they are."""
    hot = materialize(frequent_hashes(sequences, given, least), "hashes")
    number = -(-(hot.agg(F.sum(F.length("hashes"))).first()[0] or 0) // (4 * block))

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            for data in batch["hashes"]:
                h = np.frombuffer(data.as_buffer(), np.uint32)
                which = h.astype(np.int64) * number >> 32
                for k in np.unique(which).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([h[which == k].tobytes()], pa.binary())], ["block", "hot"])

    def gather(rows: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["hot"]]))
        return pa.table({"block": [rows["block"][0].as_py()], "hot": pa.array([h.tobytes()], pa.binary())})

    def run(batches: Batches) -> Batches:
        blocks = Blocks(path, keep)
        for batch in batches:
            for data in batch["data"]:
                a, b = pairs_of(data, given)
                place = pair_place(a, b)
                which, known = place * number >> 32, np.zeros(len(a), bool)
                for k in np.unique(which).tolist():
                    held = blocks[k]
                    if held is not None:
                        at = which == k
                        near = np.minimum(np.searchsorted(held["hot"], place[at]), len(held["hot"]) - 1)
                        known[at] = held["hot"][near] == place[at]
                a, b = a[known], b[known]
                if not len(a):
                    continue
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(first, append=len(a)))], ["a", "b", "n"])

    if not number:
        return sequences.sparkSession.createDataFrame([], "a long, b long")
    path = written(hot.mapInArrow(deal, "block long, hot binary").groupBy("block").applyInArrow(gather, "block long, hot binary"), "hot")
    return sequences.select("data").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("a", "b")


def word_counts(docs: DataFrame, part: int) -> DataFrame:
    """lang, word, n of all words."""

    def run(batches: Batches) -> Batches:
        for lang, words in by_language(batches, part):
            n = np.bincount(words.code, minlength=len(words.words))
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int64))), words.words.cast(pa.binary()), pa.array(n)], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def read(spark: SparkSession, paths: list[str], totals: list[str], level: int, keep: int) -> DataFrame:
    """level, slot, a (first part), b (rest), lang, phrase, n, and l, r, score of the lowest cut, of the phrases of `level` words."""

    def run(batches: Batches) -> Batches:
        keys, counts = [Blocks(p, keep) for p in paths], [Blocks(p, keep) for p in totals]
        for batch in batches:
            for block, first, rest in zip(batch["block"].to_pylist(), batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(first.as_buffer(), np.int64), np.frombuffer(rest.as_buffer(), np.int64)
                slots = np.arange(len(a)) + block * STRIDE
                n = counts[level - 1].take("counts", slots)
                # what begins at the front with 1, 2 ... words, and what ends at the end so, by going down the pairs
                front, back = {level - 1: a}, {level - 1: b}
                for k in range(level - 2, 0, -1):
                    front[k], back[k] = keys[k].take("a", front[k + 1]), keys[k].take("b", back[k + 1])
                lefts = [counts[k - 1].take("counts", front[k]).tolist() for k in range(1, level)]
                rights = [counts[level - k - 1].take("counts", back[level - k]).tolist() for k in range(1, level)]
                words = [keys[0].words(front[1])]
                for k in range(1, level):  # the last word of the first k + 1
                    piece = front[k + 1] if k + 1 < level else slots
                    for down in range(k, 0, -1):
                        piece = keys[down].take("b", piece)
                    words.append(keys[0].words(piece))
                out = []
                for i, whole in enumerate(n.tolist()):
                    _, k = min((2_000_000 * whole // (lefts[k][i] + rights[k][i]), k) for k in range(level - 1))
                    l, r = lefts[k][i], rights[k][i]
                    out.append((l, r, 2_000_000 * whole // (l + r)))
                phrases = [b" ".join(w[i].partition(b"\t")[0] for w in words).decode() for i in range(len(a))]
                langs = [w.partition(b"\t")[2].decode() for w in words[0]]
                l, r, score = (pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), level)), pa.array(slots), pa.array(a), pa.array(b), pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(n), l, r, score], ["level", "slot", "first", "rest", "lang", "phrase", "a", "l", "r", "score"])

    return spark.read.parquet(paths[level - 1]).select("block", "a", "b").mapInArrow(run, "level long, slot long, first long, rest long, lang string, phrase string, a long, l long, r long, score long")


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, block: int = BLOCK, part: int = PART, keep: int = KEEP, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a, l, r, score of the phrases of 2 to `longest` words that occur `least` times, without those that a longer one
    holds in `subsumed` of 100 cases; and lang, n: the words of each language."""
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = materialize(word_counts(texts, part), "words")
    keys = counted.filter(F.col("n") >= least).select(F.concat("word", F.lit("\t").cast("binary"), F.col("lang").cast("binary")).alias("key"))
    paths, totals, found, sequences, given = [], [], [], None, None
    for level in range(1, longest + 1):
        candidates = keys if level == 1 else materialize(sieve(sequences, given, least, block, keep), "candidates")
        path, number = index(candidates, level, block)
        if not number:
            break
        rows = numbered(texts, path, number, part, keep) if level == 1 else lengthened(sequences, given, path, number, keep)
        rows = sequences_of(rows)
        sequences, given = rows.filter("block < 0"), slot_type(number)
        paths.append(path)
        totals.append(written(added_up(rows.filter("block >= 0"), fan), f"counts{level}"))
        if level > 1:
            found.append(read(spark, list(paths), list(totals), level, keep))
    if not found:
        return spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long"), totals_by_language(counted)
    phrases = materialize(reduce(DataFrame.unionByName, found), "phrases")
    # a longer phrase is no more frequent than any part of it: those of one word more tell
    inner = phrases.filter("level > 2").select((F.col("level") - 1).alias("level"), F.explode(F.array("first", "rest")).alias("slot"), "a")
    longer = inner.groupBy("level", "slot").agg(F.max("a").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = phrases.join(longer, ["level", "slot"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * subsumed))
    return kept.select("lang", "phrase", "a", "l", "r", "score"), totals_by_language(counted)


def totals_by_language(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang").agg(F.sum("n").alias("n"))


def top(phrases: DataFrame, totals: DataFrame, limit: int = LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `limit` of each language. Parts of a language are ranked first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language."""
    return top(*mined(table(spark, sf_dir, "documents")))


ORACLE_SQL = {
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS a FROM places GROUP BY ALL
), frequent AS (
  SELECT * FROM counts WHERE a >= 30
), cuts AS (
  SELECT f.lang, f.k, f.g, f.a, unnest(range(1, f.k)) AS cut FROM frequent f WHERE f.k > 1
), scored AS (
  SELECT c.*, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.g = c.g[1:c.cut] JOIN frequent y ON y.lang = c.lang AND y.g = c.g[c.cut + 1:c.k]
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inner_ AS (
  SELECT f.lang, f.a, f.g[s:s + m - 1] AS g
  FROM frequent f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < f.k AND s + m - 1 <= f.k
), longer AS (
  SELECT lang, g, max(a) AS longest FROM inner_ GROUP BY ALL
), kept AS (
  SELECT p.lang, array_to_string(p.g, ' ') AS phrase, p.a, p.l, p.r, p.score
  FROM lowest p LEFT JOIN longer q ON q.lang = p.lang AND q.g = p.g WHERE q.g IS NULL OR 100::HUGEINT * q.longest < 80::HUGEINT * p.a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000""",
}
