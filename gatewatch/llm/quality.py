"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (low quality), 1 (fair but toxic) and 2 (good). One weight per hashed text feature is shared by all grades and
ordered thresholds part them: P(grade <= k) = sigmoid(threshold_k - score). Features are the distinct tokens of the whole text
(words in lower case and runs of signs), the words' beginnings, and binned shares of signs, upper-case words and repeated tokens. The model is fitted
by AdaGrad with an L1 penalty, which leaves all but telling features without weight, in one task, on a bounded sample of the
rated documents: PER_GRADE of each grade at most, those with the least hash of doc_id, weighted back to the grades' shares.
Features that fewer than LEAST sampled documents have stay without weight.

Defined cases: a null or empty text has no tokens and is scored from the bins alone; ratings of missing documents are not
used, nor those of null doc_ids; a document counts once for each grade that it is rated with, and of several texts under one
doc_id only one is learned from; without ratings every document gets the top grade
with probability 1; repeated rows and null doc_ids each get their row; an empty table gives an empty result; extra columns
are not read by the query and are kept by `select`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BITS, PER_GRADE, LEAST, GRADES, EPOCHS, PENALTY, KEEP = 20, 2500, 5, 3, 40, 2e-3, 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE, BEGINNINGS = 200_000, (4, 5, 6, 7)


def grade() -> Column:
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


class Features:
    """Hashed features of texts; remembers the places of tokens met lately."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = (1 << bits) - 1, {}

    def place(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(name) & self.mask

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text or "")
        distinct, known = set(tokens), self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for t in distinct:
            at = known.get(t)
            if at is None:
                low = t.lower()
                at = known[t] = [self.place(low), *[self.place(f"\n^{low[:k]}") for k in BEGINNINGS if len(low) > k]]
            out += at
        n = max(1, len(tokens))
        signs = sum(1 for t in tokens if not (t[0].isalnum() or t[0] == "_")) / n
        upper = sum(1 for t in distinct if len(t) > 1 and t.isupper()) / max(1, len(distinct))
        again = 1 - len(distinct) / n
        out += [self.place(f"\n{k}{int(v * 10)}") for k, v in (("signs", signs), ("upper", upper), ("again", again))]
        out.append(self.place(f"\nlength{int(np.log2(n))}"))
        return np.unique(np.array(out, np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """The places that have a weight, their weights, and ascending thresholds."""

    def __init__(self, places: np.ndarray, values: np.ndarray, thresholds: np.ndarray, bits: int = BITS):
        self.places, self.values, self.thresholds, self.bits = places, values, thresholds, bits

    def weights(self) -> np.ndarray:
        """The weight of every place."""
        out = np.zeros(1 << self.bits, np.float32)
        out[self.places] = self.values
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def slopes(score: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the negative log-likelihood of grade y, and its slopes by the score and by each threshold."""
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    upper, lower = _sigmoid(edge[y + 1] - score), _sigmoid(edge[y] - score)
    d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
    p = np.maximum(upper - lower, 1e-9)
    k = np.arange(len(theta))
    by_theta = (y[:, None] == k + 1) * (d_lower / p)[:, None] - (y[:, None] == k) * (d_upper / p)[:, None]
    return -np.log(p), (d_upper - d_lower) / p, by_theta


def fit(lists: list[np.ndarray], grades: np.ndarray, emphasis: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> OrdinalModel:
    """Minimises the negative log-likelihood of the grades, rows weighted by emphasis, plus PENALTY times the absolute weights."""
    n, k = len(lists), GRADES - 1
    length = np.array([len(x) for x in lists])
    places, flat, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    frequent = times >= LEAST
    places, flat = places[frequent], np.where(frequent, np.cumsum(frequent) - 1, -1)[flat]  # only these are numbered
    row = np.repeat(np.arange(n), length)[flat >= 0]
    flat, size = flat[flat >= 0], len(places)
    length = np.bincount(row, minlength=n)
    start = np.cumsum(length) - length
    weights, squares = np.zeros(size), np.full(size, 1e-3)
    share = np.maximum(1e-6, np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n)
    theta = np.maximum.accumulate(np.log(share / np.maximum(1e-6, 1 - share)) + 1e-3 * np.arange(k))
    tsquares = np.full(k, 1e-3)
    emphasis = emphasis * n / emphasis.sum()
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(n)
        for rows in np.array_split(order, max(1, n // 256)):
            each = length[rows]
            ends = np.cumsum(each)
            own = np.repeat(np.arange(len(rows)), each)
            place = flat[np.repeat(start[rows] - (ends - each), each) + np.arange(ends[-1])]
            score = np.bincount(own, weights[place], minlength=len(rows))
            _, by_score, by_theta = slopes(score, grades[rows], theta)
            g = np.bincount(place, (emphasis[rows] * by_score)[own], minlength=size) / len(rows)
            touched = np.flatnonzero(g)
            g = g[touched]
            squares[touched] += g * g
            rate = 0.3 / np.sqrt(squares[touched])
            moved = weights[touched] - rate * g
            weights[touched] = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * PENALTY)
            g = (emphasis[rows, None] * by_theta).mean(0)
            tsquares += g * g
            theta = np.maximum.accumulate(theta - 0.1 * g / np.sqrt(tsquares))
    on = weights != 0
    return OrdinalModel(places[on].astype(np.int32), weights[on].astype(np.float32), theta)


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> OrdinalModel | None:
    """Fits on per_grade rated documents of each grade at most: the bound of the sample, of its broadcast and of the one task
    that fits it. Only the weights come to the driver."""
    rated = labels.filter("quality is not null and doc_id is not null").select("doc_id", grade().alias("grade")).distinct()
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if not counts:
        return None
    # a hash of doc_id leaves a few more than wanted, of which the least hashes are taken
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for g, c in counts.items() for x in (g, min(1.0, 1.5 * per_grade / c))])
    near = rated.withColumn("at", place).filter(F.col("at") < F.element_at(share, F.col("grade")) * (1 << 30))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("grade").orderBy("at", "doc_id")))
    chosen = ranked.filter(F.col("r") <= per_grade).select("doc_id", "grade")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            lists = [features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "grade", "places"])

    emphasis = np.array([max(1.0, counts.get(g, 0) / per_grade) for g in range(GRADES)])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            rows = pa.Table.from_batches(found).sort_by([("doc_id", "ascending"), ("grade", "ascending")])
            grades = rows["grade"].to_numpy().astype(np.int64)
            model = fit([np.array(x, np.int32) for x in rows["places"].to_pylist()], grades, emphasis[grades])
            at = np.concatenate([-1 - np.arange(GRADES - 1), model.places])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.concatenate([model.thresholds, model.values]))], ["place", "value"])

    found = sample.select("doc_id", "grade", "text").mapInArrow(featurize, "doc_id long, grade int, places array<int>")
    once = found.groupBy("doc_id", "grade").agg(F.min("places").alias("places"))  # of several rows under one doc_id
    fitted = once.coalesce(1).mapInArrow(fit_all, "place int, value double").toArrow().sort_by("place")
    if not len(fitted):
        return None
    at, value = fitted["place"].to_numpy(), fitted["value"].to_numpy()
    return OrdinalModel(at[at >= 0], value[at >= 0].astype(np.float32), value[at < 0][::-1].copy())


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """docs with expected_grade, p_fair = P(grade >= 1) and p_good = P(grade >= 2)."""
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(float(GRADES - 1)), "p_fair": F.lit(1.0), "p_good": F.lit(1.0)})
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        weights = model.weights()
        for batch in batches:
            scores = np.array([weights[features(t)].sum(dtype=np.float64) for t in batch[at].to_pylist()])
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])], [*names, "expected_grade", "p_fair", "p_good"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kept}, expected_grade double, p_fair double, p_good double")


def select(docs: DataFrame, model: OrdinalModel | None, least: float = KEEP) -> DataFrame:
    """The documents that are good with a probability of `least` or more, with their own columns, whatever these are called."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, model).filter(F.col("p_good") >= least).select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the expected grade, the tail probabilities and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "p_fair", "p_good", (F.col("p_good") >= KEEP).alias("kept"))
