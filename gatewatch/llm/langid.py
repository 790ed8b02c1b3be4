"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Per language a context tree over the preceding bytes of lower-cased UTF-8 text holds symbol counts, up to ORDER bytes deep.
A byte costs, at its longest known context, -log2(count / (total + distinct)); a byte unseen there costs the escape
-log2(distinct / (total + distinct)) and then what it costs one byte shorter, down to 8 bits without any context. All these
code lengths are computed once into a table over (context, byte, language), so scoring a text is table look-ups in numpy.
The language with the shortest code wins; the score is its probability among the languages at equal prior odds.

The statistics come from a bounded sample: about PER_LANG documents of each language, chosen by a hash of their text; equal texts
count once. They count every byte of it. A context is used from LEAST occurrences in one language on, below which its escapes say
little; the table holds at most MAX_CELLS numbers, so its broadcast is bounded however large the input and however many the
languages: the contexts with the highest counts stay, and a context's shorter ones always count at least as much. With very
many languages contexts get shorter.

Defined cases: a null text, and one without a letter, is `und` with score 0; so is every text if nothing can be learned;
ties go to the first language in byte order; null doc_ids are not learned from and not held out; repeated rows each get
their row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORDER, PER_LANG, MAX_CELLS, LEAST, CHUNK = 4, 1500, 9_000_000, 6, 1 << 18


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column with ORDER zero bytes before each value, and where the values start in them."""
    values = [x or b"" for x in column.to_pylist()]
    length = np.array([len(v) + ORDER for v in values], np.int64)
    return np.frombuffer(b"".join(bytes(ORDER) + v for v in values), np.uint8), np.cumsum(length) - length


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: occurrences of each byte with its context, packed into a long, over the documents (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in sorted(set(batch["lang"].to_pylist())):
                own = batch.filter(pa.compute.equal(batch["lang"], lang))
                raw, start = _flat(own["text"])
                gram = np.zeros(max(0, len(raw) - order), np.int64)
                for j in range(order + 1):
                    gram = gram << 8 | raw[j : len(raw) - order + j]
                inside = np.ones(len(raw), bool)
                inside[(start[:, None] + np.arange(order)).ravel()] = False
                value, n = np.unique(gram[inside[order:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = docs.select("lang", F.lower("text").cast("binary").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Ppm:
    """The frozen trees: `symbol` of each byte, `child` of (node, symbol before), `cost` of (node, symbol, language) in bits."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER, max_cells: int = MAX_CELLS):
        self.langs, self.order = langs, order
        seen = np.unique(gram & 255)
        self.symbol = np.full(256, len(seen), np.uint8 if len(seen) < 256 else np.int16)  # the last symbol stands for bytes never seen
        self.symbol[seen] = np.arange(len(seen))
        width, languages = len(seen) + 1, len(langs)
        room = max(1, max_cells // (width * languages))
        # contexts of each depth with the highest count in any language
        levels = []
        for depth in range(1, order + 1):
            key = (gram >> 8) & ((1 << 8 * depth) - 1)
            values, place = np.unique(key, return_inverse=True)
            total = np.zeros((len(values), languages))
            np.add.at(total, (place, lang), n)
            levels.append((values, total.max(1)))
        best = np.sort(np.concatenate([t for _, t in levels]))[::-1]
        bar = max(LEAST, best[room - 1] + 1 if len(best) >= room else 0)
        kept = [v[t >= bar] for v, t in levels]
        first = np.cumsum([1, *map(len, kept)])
        nodes = int(first[-1])
        self.child = np.full((nodes, width), -1, np.int32)
        parent = np.zeros(nodes, np.int64)

        def node_of(key: np.ndarray, depth: int) -> np.ndarray:
            """The node of each context of that depth, -1 if it isn't kept."""
            if depth == 0:
                return np.zeros(len(key), np.int64)
            own = kept[depth - 1]
            if not len(own):
                return np.full(len(key), -1)
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            return np.where(own[at] == key, at + first[depth - 1], -1)

        for depth in range(1, order + 1):
            key, own = kept[depth - 1], np.arange(first[depth - 1], first[depth])
            above = node_of(key & ((1 << 8 * (depth - 1)) - 1), depth - 1)
            parent[own] = above
            self.child[above, self.symbol[key >> 8 * (depth - 1)]] = own
        counts = np.zeros((nodes, width, languages), np.float32)
        for depth in range(order + 1):
            node = node_of((gram >> 8) & ((1 << 8 * depth) - 1), depth)
            there = node >= 0
            np.add.at(counts, (node[there], self.symbol[gram[there] & 255], lang[there]), n[there])
        self.cost = np.full((nodes, width, languages), 8.0, np.float32)
        for depth in range(order + 1):
            own = np.arange(first[depth - 1], first[depth]) if depth else np.arange(1)
            c = counts[own]
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            shorter = self.cost[parent[own]] if depth else self.cost[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                found = -np.log2(c / (total + distinct))
                escaped = -np.log2(distinct / (total + distinct)) + shorter
            self.cost[own] = np.where(c > 0, found, np.where(total > 0, escaped, shorter))

    def bits(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Code length of each value of _flat in each language."""
        width, languages = self.cost.shape[1:]
        child, cost = self.child.ravel(), self.cost.reshape(-1, languages)
        symbol = self.symbol[raw].astype(np.int64)
        out, end = np.zeros((len(start), languages)), np.append(start[1:], len(raw))
        doc_of = np.repeat(np.arange(len(start)), end - start)
        inside = np.ones(len(raw), bool)
        inside[(start[:, None] + np.arange(self.order)).ravel()] = False
        at = np.flatnonzero(inside)
        for a in range(0, len(at), CHUNK):
            i = at[a : a + CHUNK]
            node = np.zeros(len(i), np.int64)
            live = np.ones(len(i), bool)
            for depth in range(1, self.order + 1):
                below = child[node * width + symbol[i - depth]]
                live &= below >= 0
                node = np.where(live, below, node)
            spent = cost[node * width + symbol[i]]
            doc = doc_of[i]
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[cut]] += np.add.reduceat(spent, cut, axis=0, dtype=np.float64)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        bits = self.bits(*_flat(column))
        best = bits.argmin(1)
        return [self.langs[b] for b in best], 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)


def learn(docs: DataFrame, per_lang: int = PER_LANG, max_cells: int = MAX_CELLS) -> Ppm | None:
    """Learns from documents (doc_id, text, lang): a sample of about per_lang documents of each language."""
    known = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts, key=str.encode)
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_lang / v))])
    sample = known.filter(F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))
    # a text counts once however many copies the sample has of it
    sample = sample.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    grams = gram_counts(sample).select(F.element_at(place, F.col("lang")).alias("lang"), "gram", F.col("n").cast("int").alias("n")).toArrow()
    if not len(grams):
        return None
    return Ppm(langs, grams["lang"].to_numpy(), grams["gram"].to_numpy(), grams["n"].to_numpy().astype(np.float32), max_cells=max_cells)


def identify(docs: DataFrame, model: Ppm | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score of every text."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.lower("text").cast("binary")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lang, score = shared.value.predict(part["_text"])
                blank = part["_text"].is_null().to_pylist()
                lang = ["und" if b else x for b, x in zip(blank, lang)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(np.where(blank, 0.0, score))], [*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the language of its whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = learn(docs.filter("doc_id is not null and not held_out"))
    return identify(docs, model, ("doc_id", "held_out"))
