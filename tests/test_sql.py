"""The functions for SQL against the column expressions and operators that do the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import geometry as G
from gatewatch.functions import plate_text, sql
from gatewatch.functions import plates as P
from gatewatch.operators import joins
from gatewatch.sources import tables as T


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sql.register(spark)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    found = {"".join(r.choice("ABDZ01258OISbg -") for _ in range(r.randrange(0, 12))) for _ in range(4000)} | {"B1234CD", "B0", "AB12C", "ZZ1234AB", "B01234C", "123AB", "D77X", "K0X", "b 0012 cd"}
    return spark.createDataFrame([(t,) for t in sorted(found)] + [(None,)], "text string").cache()


def test_plates_one_by_one_are_those_of_the_column(texts):
    """Original, corrected, valid, penalty and candidates, for thousands of texts."""
    rows = texts.select("text", P.correct(F.col("text")).alias("c")).collect()
    for r in rows:
        mine, c = plate_text.correct(r["text"]), r["c"]
        assert (mine["original"], mine["corrected"], mine["valid"], mine["candidates"]) == (c["original"], c["corrected"], c["valid"], c["candidates"]), r["text"]
        assert mine["penalty"] == pytest.approx(c["penalty"])
    assert 100 < sum(r["c"]["valid"] for r in rows) < len(rows) - 100


def test_scalars_from_sql(spark, texts):
    texts.createOrReplaceTempView("texts")
    got = spark.sql("select text, plate_check(text) as c, plate_status(text, 0.8, 0.5) as s, plate_status(text, null, null) as n, plate_segments(text) as p from texts")
    want = texts.select("text", P.correct(F.col("text")).alias("c"), P.status(F.col("text"), F.lit(0.8), F.lit(0.5)).alias("s"), P.status(F.col("text"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("n"), P.parse(F.col("text")).alias("p"))
    plain = lambda r: (r["text"] is None, r["text"] or "", r["c"]["corrected"], r["c"]["valid"], r["s"], r["n"], tuple((r["p"] or (None,) * 3)[:]))
    assert sorted(map(plain, got.collect()), key=str) == sorted(map(plain, want.collect()), key=str)


def test_zones_from_sql(spark, sf):
    T.boxes(spark, sf).createOrReplaceTempView("boxes")
    near, mid = "array(array(0d, 300d), array(800d, 320d), array(700d, 500d), array(0d, 500d))", "array(array(100d, 100d), array(700d, 150d), array(400d, 400d))"
    got = spark.sql(f"select box_id, box_zone(x1, y1, x2, y2, {near}, {mid}) as zone from boxes")
    want = T.boxes(spark, sf).select("box_id", G.zone_of(G.box(), F.expr(near), F.expr(mid)).alias("zone"))
    assert sorted(got.collect()) == sorted(want.collect()) and want.select("zone").distinct().count() == 3


def test_table_functions_from_sql(spark, sf):
    boxes = T.boxes(spark, sf)
    boxes.createOrReplaceTempView("boxes")
    got = spark.sql("select box_id from kept_boxes(table(boxes) partition by frame order by (confidence desc, box_id))")
    assert sorted(got.collect()) == sorted(joins.suppressed(boxes).collect())
    a, b = boxes.filter("box_id % 2 = 0"), boxes.filter("box_id % 2 = 1")
    pairs = joins._pairs(a, b).withColumn("iou", G.iou(G.box("a_"), G.box("b_"))).filter("iou >= 0.1")
    pairs.select("frame", "a_box_id", "b_box_id", "iou").createOrReplaceTempView("pairs")
    got = spark.sql("select frame, detection, track from one_to_one(table(pairs) partition by frame order by (iou desc, a_box_id, b_box_id))")
    assert sorted(got.collect()) == sorted(joins.greedy_matches(a, b, 0.1).collect()) and got.count() > 5


def test_candidates_from_sql(spark):
    rows = spark.createDataFrame([(1, '{"candidates": [{"text": "B 1234 CD", "confidence": 0.6}, {"text": "D77X", "confidence": 0.9}, {"text": "??", "confidence": 0.99}, {"text": null}]}'), (2, '{"candidates": []}'), (3, "broken"), (4, None), (5, '{"candidates": [3, {"text": "OO"}]}')], "id long, meta string")
    rows.createOrReplaceTempView("captures")
    got = spark.sql("select id, c.* from captures, lateral plate_candidates(meta) c order by id, place").collect()
    assert [(r["id"], r["place"], r["corrected"], r["valid"], r["best"]) for r in got] == [(1, 0, "B1234CD", True, False), (1, 1, "D77X", True, True), (1, 2, "", False, False), (1, 3, "", False, False), (5, 0, "OO", False, False)]
