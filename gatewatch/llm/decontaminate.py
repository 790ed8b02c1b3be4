"""Benchmark decontamination: n-gram seeds find candidates, Smith-Waterman alignment scores them.

Texts are compared as words in lower case. The seeds of a benchmark item are all its trigrams, however frequent: three words in a
row, and three of four with the third left out. Documents are searched for both forms of both, so a seed survives a word that was
replaced, added or left out within it. Where a document has a seed, the stretch of the document around the matching place is
aligned with the item: a match counts 2, a mismatch and a gap -1. The score is the best local alignment over that of the item
with itself; from LEAST on, the document holds an exact, edited or paraphrased copy of the item. A document's seeds are grouped
by diagonal, so that two copies in one text are two alignments; of overlapping alignments with one item the best stays. A stretch
that has too few of the item's words for LEAST, even if all of them matched, is not aligned: a proof, not a cut. An alignment
from LEAST on, in which words were only replaced, has a seed; with a word added at almost every place it may have none.

The benchmark is the stated query set: its words and seeds are broadcast in blocks of at most BLOCK items, one after the other
for a larger benchmark, so the broadcast has a fixed bound. The documents are read once a block and never shuffled; only
matches move.

Defined cases: null and empty texts hold nothing; items under SEED words are sought as a whole phrase, but too common to reject a document by (`decontaminate`
passes them over); items without words are not sought; equal items are each reported; repeated documents each get their rows; null doc_ids are kept; an empty documents
or benchmark table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEED, LEAST, BLOCK = 3, 0.5, 20_000
#: Places of a seed's words, and the characters of a block of items at most (trigrams of numbered words fit into 64 bits).
FORMS, BLOCK_CHARS = ((0, 1, 2), (0, 1, 3)), 2_000_000
WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = "doc_id long, item_id long, score double, first_word long, last_word long, digest binary"


class Items:
    """A block of benchmark items: numbered words, the n-grams as numbers and where each stands in which item."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        tokens = [WORD.findall(t.lower()) for _, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
        self.words = [np.array([self.vocabulary[w] for w in t], np.int64) for t in tokens]
        self.width = len(self.vocabulary) + 1
        where = defaultdict(set)
        for item, w in enumerate(self.words):
            for form in FORMS if len(w) >= SEED else (tuple(range(len(w))),):
                at = np.arange(len(w) - max(form, default=0)) if form else np.zeros(0, np.int64)
                for place, gram in zip(at.tolist(), self.grams(w, at, form).tolist()):
                    where[gram].add((item, place))
        self.gram = np.array(sorted(where), np.int64)
        self.where = [sorted(where[g]) for g in self.gram.tolist()]

    def grams(self, words: np.ndarray, at: np.ndarray, form: tuple[int, ...]) -> np.ndarray:
        """The words at those places as one number; fewer words never equal more."""
        out = np.full(len(at), len(form), np.int64)
        for j in form:
            out = out * self.width + words[at + j] + 1
        return out

    def numbered(self, text: str) -> np.ndarray:
        known = self.vocabulary
        return np.array([known.get(w, -1) for w in WORD.findall(text.lower())], np.int64)

    def hits(self, words: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text that hold one of `among` (sorted n-grams), and which."""
        places, found = [], []
        known = np.flatnonzero(words >= 0)
        for form in (*(tuple(range(n)) for n in range(1, SEED) if self.short(n)), *FORMS):
            at = known[known < len(words) - form[-1]]
            for j in form[1:]:
                at = at[words[at + j] >= 0]
            gram = self.grams(words, at, form)
            k = np.minimum(np.searchsorted(among, gram), len(among) - 1)
            ok = among[k] == gram
            places.append(at[ok])
            found.append(k[ok])
        return np.concatenate(places), np.concatenate(found)

    def short(self, n: int) -> bool:
        return any(len(w) == n for w in self.words)


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local alignment of each pair: score, and start and end of the aligned stretch of the window. All pairs in step."""
    if not windows:
        return []
    n, rows, columns = len(windows), max(map(len, items)), max(map(len, windows))
    a, b = np.full((n, rows), -2, np.int64), np.full((n, columns), -3, np.int64)
    for k, (w, i) in enumerate(zip(windows, items)):
        b[k, : len(w)], a[k, : len(i)] = w, i
    score, begin = np.zeros((n, columns + 1), np.int32), np.tile(np.arange(columns + 1, dtype=np.int32), (n, 1))
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    place, all_rows = np.arange(columns + 1, dtype=np.int32), np.arange(n)
    for r in range(rows):
        diagonal = score[:, :-1] + np.where(a[:, r, None] == b, MATCH, MISMATCH).astype(np.int32)
        up = score[:, 1:] + GAP
        take = diagonal >= up
        new, start = np.zeros_like(score), np.tile(place, (n, 1))
        new[:, 1:] = np.where(take, diagonal, up)
        start[:, 1:] = np.where(take, begin[:, :-1], begin[:, 1:])
        start[new <= 0] = np.broadcast_to(place, start.shape)[new <= 0]
        np.maximum(new, 0, out=new)
        # gaps along the row: the best of new[j'] + GAP * (j - j'), by a running maximum
        lifted = (new - GAP * place).astype(np.int64) * (columns + 2) + (columns + 1 - place)
        source = columns + 1 - np.maximum.accumulate(lifted, axis=1) % (columns + 2)
        shifted = np.take_along_axis(new, source, 1) + GAP * (place - source)
        better = shifted > new
        start = np.where(better, np.take_along_axis(start, source, 1), start)
        score, begin = np.where(better, shifted, new), start
        top = score.argmax(1)
        value = score[all_rows, top]
        up_now = value > best
        best[up_now], last[up_now], first[up_now] = value[up_now], top[up_now], begin[all_rows, top][up_now]
    return list(zip(best.tolist(), first.tolist(), last.tolist()))


def _blocks(benchmark: DataFrame, size: int) -> Iterator[Items]:
    """The benchmark in blocks of `size` items and BLOCK_CHARS characters at most (or one item), in the order of item_id; only
    one block is on the driver at a time."""
    rows, chars = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) == size or chars + len(r["text"]) > BLOCK_CHARS):
            yield Items(rows)
            rows, chars = [], 0
        rows.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if rows:
        yield Items(rows)


def matchable(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """At most so many words of each item can match in its window."""
    a, b = (np.full((len(x), max(map(len, x))), fill, np.int64) for x, fill in ((items, -2), (windows, -3)))
    for k, (w, i) in enumerate(zip(windows, items)):
        b[k, : len(w)], a[k, : len(i)] = w, i
    equal = a[:, :, None] == b[:, None, :]
    return np.minimum(equal.any(2).sum(1), equal.any(1).sum(1))


def _apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of alignments (share, first, last) that overlap, the best."""
    kept = []
    for share, first, last in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if all(last <= x or first >= y for _, x, y in kept):
            kept.append((share, first, last))
    return kept


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, digest (of the text) of every benchmark item found in a document (doc_id, text)."""
    found = None
    chosen = docs.select("doc_id", "text").filter("text is not null")
    spark = docs.sparkSession
    for items in _blocks(benchmark, block):
        if not len(items.gram):
            continue
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                doc_ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
                pairs = []
                for row, text in enumerate(texts):
                    words = items.numbered(text)
                    bins = set()
                    for at, k in zip(*(x.tolist() for x in items.hits(words, items.gram))):
                        for item, own in items.where[k]:
                            size = max(8, len(items.words[item]))
                            d = (at - own) // size
                            bins |= {(item, d)} if (at - own) % size == 0 else {(item, d), (item, d + 1)}
                    for item, d in bins:
                        size = max(8, len(items.words[item]))
                        start = max(0, d * size - size)
                        pairs.append((row, item, start, words[start : d * size + 2 * size]))
                rows = defaultdict(set)
                for at in range(0, len(pairs), 2000):
                    part = sorted(pairs[at : at + 2000], key=lambda p: len(p[3]))
                    likely = []
                    for lo in range(0, len(part), 100):
                        some = part[lo : lo + 100]
                        most = matchable([p[3] for p in some], [items.words[p[1]] for p in some]).tolist()
                        likely += [p for p, n in zip(some, most) if n >= least * len(items.words[p[1]])]
                    for lo in range(0, len(likely), 200):
                        some = likely[lo : lo + 200]
                        for (row, item, start, _), (score, first, last) in zip(some, align([p[3] for p in some], [items.words[p[1]] for p in some])):
                            share = score / (MATCH * len(items.words[item]))
                            if share >= least:
                                rows[row, item].add((share, start + first, start + last))
                digests = {row: hashlib.md5(texts[row].encode()).digest() for row, _ in rows}
                out = [(doc_ids[row], items.ids[item], *place, digests[row]) for (row, item), places in rows.items() for place in _apart(list(places))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in FOUND.split(", ")])

        here = chosen.mapInArrow(search, FOUND)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], FOUND)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns. A row goes by its doc_id and text, so other texts of
    the same doc_id, or of none, stay."""
    sought = benchmark.filter(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))) >= SEED)
    hit = matches(docs, sought, least).select(F.col("doc_id").alias("_hit"), F.col("digest").alias("_digest")).distinct()
    same = F.unhex(F.md5(docs["text"].cast("binary"))) == hit["_digest"]
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]) & same, "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item found in it, the best alignment's score and number of places; texts of one doc_id, or of
    none, are documents of their own, repeated rows are one."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    places = found.distinct()
    return places.groupBy("doc_id", "digest", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("n_places")).drop("digest")
