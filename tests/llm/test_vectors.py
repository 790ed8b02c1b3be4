"""Whitening against numpy over all rows, and on odd tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import whitening
from gatewatch.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(vectors):
    """Plain numpy and Python integers over the whole fit list."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    z = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    cov = z.T @ z / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    return n, deviation, z @ axes / np.sqrt(values), values / np.trace(cov)


def matches(got, ids, vectors):
    n, deviation, white, explained = expected(vectors)
    rows = sorted(got.collect(), key=lambda r: (r["vec_id"], r["component"]))
    k = len(explained)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    assert [r["vec_id"] for r in rows[::k]] == ids and [r["component"] for r in rows[:k]] == list(range(1, k + 1))
    assert [r["deviation"] for r in rows[::k]] == deviation
    mine = np.array([r["whitened"] for r in rows]).reshape(n, k)
    sign = np.sign((mine * white).sum(0))
    np.testing.assert_allclose(mine * sign, white, rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whole_table(spark, sf):
    rows = sorted(table(spark, sf, "embeddings").collect(), key=lambda r: r["vec_id"])
    matches(whitening.op13_whitening(spark, sf), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("tile, block", [(3, 7), (10, 1), (64, 1000)])
def test_tiles_and_blocks_of_any_size(spark, tile, block):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(90, 10)) @ rng.normal(size=(10, 10)) + 5).tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    matches(whitening.whitened(df, tile=tile, block=block), list(range(90)), vectors)


def test_odd_rows(spark, tmp_path):
    """Null, empty, short, non-finite vectors go; null and repeated ids stay; clashing columns are not read."""
    rng = np.random.default_rng(2)
    good = rng.normal(size=(40, 9)).tolist()
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(100, None, 0), (101, [], 0), (102, [1.0, 2.0], 0), (103, [None, *good[0][1:]], 0), (104, [float("nan"), *good[0][1:]], 0), (105, [-float("inf"), *good[0][1:]], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit("mine"), "n": F.lit(1), "rows": F.lit(2)})
    matches(whitening.whitened(df), list(range(40)), good)
    twice = spark.createDataFrame([(None, v, 0) for v in good] + [(7, v, 0) for v in good], SCHEMA)
    got = whitening.whitened(twice).groupBy("vec_id").count().collect()
    assert {r["vec_id"]: r["count"] for r in got} == {None: 320, 7: 320}
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op13_whitening(spark, str(tmp_path)).count() == 320


def test_small_and_constant_tables(spark):
    empty = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    alone = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(alone, key=lambda r: r["component"])] == [(1, 1, 0, 0.0, 0.0, 1.0), (2, 1, 0, 0.0, 0.0, 1.0)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0], 0) for i in range(20)], SCHEMA)).collect()
    assert {r["component"]: round(r["explained"], 12) for r in line} == {1: 1.0, 2: 0.0, 3: 0.0} and {r["whitened"] for r in line if r["component"] > 1} == {0.0}


def test_deviations_beyond_64_bits_are_null(spark):
    rows = whitening.whitened(spark.createDataFrame([(0, [1e300, 0.0], 0), (1, [-1e300, 1.0], 0), (2, [0.0, 3.0], 0)], SCHEMA)).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in rows} == {0: True, 1: True, 2: False}
    large = [[1e7 + i * i, -1e9 * i] for i in range(30)]  # needs the exact integers, fits 64 bits only in part
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in enumerate(large)], SCHEMA)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(expected(large)[1])}
