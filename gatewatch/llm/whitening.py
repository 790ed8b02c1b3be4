"""Embedding whitening by a tiled covariance.

Entries become integers, so that counts, sums and deviations are exact. The dimensions are cut into blocks of TILE columns and
the rows into blocks of BLOCK rows. Each pair of column blocks is a tile: for every block of rows its two column blocks
meet in one task, which multiplies them and adds the products up by tile. The tiles, one number for each pair of dimensions,
are assembled in the driver, whose share so grows with the dimension and not with the rows. The eigenvectors follow there.

Rows are centred before multiplying: by the integer next to the mean, whose rest (half at most) is taken off at the end, so
that the products are whole numbers, exact below 2^53.

Defined cases: rows with a null vector, or with a null or non-finite entry, are dropped, as are empty vectors and those whose
length is not the commonest one (of two lengths as common the longer counts); entries beyond 2^51 count as 2^51; null and
repeated vec_ids are rows like others; with fewer dimensions than components there are as many components as dimensions; a
component without variance (fewer rows than components, constant vectors) has whitened 0 and explained 0, and an identity error
of 1 follows; a deviation beyond 64 bits is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Columns of a tile, rows of a block, components returned.
TILE, BLOCK, COMPONENTS = 32, 4096, 8
#: x = floor(SCALE * c) + SHIFT; entries are cut to LARGEST before, so that differences fit 64 bits.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**51
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Batches = Iterator[pa.RecordBatch]


@dataclass
class Moments:
    """Of the fit list: rows, exact sums of x by dimension, and the integer next to each mean."""

    n: int
    sums: list[int]

    @property
    def centre(self) -> np.ndarray:
        return np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Mean less centre, half at most."""
        return np.array([float(Fraction(s, self.n) - round(Fraction(s, self.n))) for s in self.sums])


@dataclass
class Whitening:
    """Components as columns of `axes`, their eigenvalues, and the trace of the covariance."""

    moments: Moments
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.moments.centre).astype(np.float64) - self.moments.rest
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0)
        return centred @ self.axes * scale


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and v (array<double>) of the rows that remain, and their dimension."""
    entry = F.col("v")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(entry.isNotNull() & (F.size(entry) > 0))
    rows = rows.filter(~F.exists(entry, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    common = rows.groupBy(F.size(entry).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.filter(F.size(entry) == d), d


def whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of a batch, (rows, d)."""
    entries = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(entries, -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT


def moments(rows: DataFrame, d: int) -> Moments:
    """Each task adds its rows up in two halves of 32 bits, which can't overflow."""

    def add(batches: Batches) -> Batches:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = whole(batch, d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = rows.select("v").mapInArrow(add, "dim long, n long, high long, low long")
    total = parts.groupBy("dim").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    by_dim = {r["dim"]: r for r in total.collect()}  # a row for each dimension
    sums = [(int(by_dim[i]["high"]) << 32) + int(by_dim[i]["low"]) for i in range(d)]
    return Moments(by_dim[0]["n"], sums)


def covariance(rows: DataFrame, d: int, m: Moments, tile: int = TILE, block: int = BLOCK) -> np.ndarray:
    """The covariance of x, divisor n, assembled from its tiles."""
    centre, blocks = m.centre, -(-d // tile)

    def deal(batches: Batches) -> Batches:
        """The column blocks of each block of rows, once for each tile that needs them."""
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                z = (whole(batch.slice(at, block), d) - centre).astype(np.float64)
                columns = [np.ascontiguousarray(z[:, c * tile : (c + 1) * tile]).tobytes() for c in range(blocks)]
                for i in range(blocks):
                    for j in range(i, blocks):
                        sides = [i] if i == j else [i, j]
                        arrays = [[i] * len(sides), [j] * len(sides), [task << 32 | k] * len(sides), sides]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array([columns[c] for c in sides], pa.binary())], ["i", "j", "rows", "side", "z"])
                k += 1

    def width(c: int) -> int:
        return min(tile, d - c * tile)

    def out(i: int, j: int, product: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([product.tobytes()], pa.binary())], ["i", "j", "product"])

    def multiply(batches: Batches) -> Batches:
        """The two column blocks of a tile and block of rows follow each other; one sum a tile is kept."""
        now, total, left = None, None, b""
        for batch in batches:
            for i, j, side, z in zip(*(batch[c].to_pylist() for c in ("i", "j", "side", "z")), strict=True):
                if now != (i, j):
                    if now:
                        yield out(*now, total)
                    now, total = (i, j), np.zeros((width(i), width(j)))
                if side == i:
                    left = z
                if side == j:
                    total += np.frombuffer(left).reshape(-1, width(i)).T @ np.frombuffer(z).reshape(-1, width(j))
        if now:
            yield out(*now, total)

    def add(batches: Batches) -> Batches:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, product in zip(*(batch[c].to_pylist() for c in ("i", "j", "product")), strict=True):
                part = np.frombuffer(product).reshape(width(i), width(j))
                sums[i, j] = sums[i, j] + part if (i, j) in sums else part
        for (i, j), total in sums.items():
            yield out(i, j, total)

    dealt = rows.select("v").mapInArrow(deal, "i long, j long, rows long, side long, z binary")
    met = dealt.repartition("i", "j", "rows").sortWithinPartitions("i", "j", "rows", "side")
    products = met.mapInArrow(multiply, "i long, j long, product binary")
    tiles = products.repartition("i", "j").mapInArrow(add, "i long, j long, product binary")
    v = np.zeros((d, d))
    for r in tiles.toLocalIterator():  # d * d / 2 numbers
        part = np.frombuffer(r["product"]).reshape(width(r["i"]), width(r["j"]))
        at, to = slice(r["i"] * tile, r["i"] * tile + width(r["i"])), slice(r["j"] * tile, r["j"] * tile + width(r["j"]))
        v[at, to], v[to, at] = part, part.T
    return v / m.n - np.outer(m.rest, m.rest)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, tile: int = TILE, block: int = BLOCK) -> Whitening:
    m = moments(rows, d)
    v = covariance(rows, d, m, tile, block)
    values, axes = np.linalg.eigh(v)
    values, axes, trace = values[::-1][:components], axes[:, ::-1][:, :components], float(np.trace(v))
    # what rounding leaves of a component without variance isn't one
    return Whitening(m, axes, np.where(values > trace * d * np.finfo(float).eps, values, 0.0), trace)


def identity_error(rows: DataFrame, d: int, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(w.values)

    def add(batches: Batches) -> Batches:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = w.project(whole(batch, d))
            total, square = total + y.sum(0), square + y.T @ y
        values = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

    sums = rows.select("v").mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(k + k * k)
    for r in sums.collect():  # k + k * k rows
        values[r["at"]] = r["value"]
    mean = values[:k] / w.moments.n
    return float(np.abs(values[k:].reshape(k, k) / w.moments.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
    rest = [s - m.n * int(c) for s, c in zip(m.sums, m.centre, strict=True)]
    z = x - m.centre
    if (int(np.abs(z).max(initial=0)) + 1) ** 2 * m.n**2 * x.shape[1] < 2**63:
        return ((m.n * z - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    sums = ((z.astype(object) * m.n - np.array(rest, object)) ** 2).sum(1)
    return [s if s < 2**63 else None for s in sums.tolist()]


def whitened(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and component."""
    rows, d = usable(vectors, key, vector)
    if not d:
        return vectors.sparkSession.createDataFrame([], RESULT)
    w = fit(rows, d, components, tile, block)
    error, k = identity_error(rows, d, w), len(w.values)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = whole(batch, d)
            rep = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].cast(pa.int64()).take(pa.array(rep)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rep), w.moments.n)),
                pa.array(deviations(x, w.moments), pa.int64()).take(pa.array(rep)), pa.array(w.project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rep), error)),
            ], RESULT.replace(",", "").split()[::2])

    return rows.mapInArrow(run, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first eight whitened components."""
    return whitened(table(spark, sf_dir, "embeddings"))
