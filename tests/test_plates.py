"""Golden vectors of plate validity, status and votes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import plates as P
from gatewatch.operators.votes import best_valid, votes

VALID = ["B1", "D1", "RI1", "D123", "AB1234CD", "H99Z", "DK8888XX", "KT1000A", "G1234AB", "B 1", "AB 1234 CD", "L2", "B123A", "D1987XYZ", "L4EDC"]
INVALID = ["1531", "18102513", "8888", "1234", "0123", "99999", "MERE", "URA", "18IE", "XYZ999", "123AB", "A", "BB", "B0", "POLISI", "19172219", "OA", "ZZ1234ZZ", "", None]


def _texts(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_validity(spark):
    rows = _texts(spark, VALID + INVALID).select("text", P.is_valid(F.col("text")).alias("v")).collect()
    got = {r["text"]: r["v"] for r in rows}
    assert [t for t in VALID if not got[t]] == []
    assert [t for t in INVALID if got[t]] == []


STATUS = [
    ("AB1234CD", 0.85, 0.90, 1), ("AB1234CD", 0.55, 0.90, 2), ("MERE", 0.75, None, 0), ("18102513", 0.80, None, 0), ("ZZ1234ZZ", 0.95, 0.95, 2), ("L4EDC", 0.95, 0.30, 2),
    ("AB1234CD", 0.95, 0.30, 2), ("AB1234CD", 0.95, 0.90, 1), ("B1", 0.75, 0.90, 1), ("", 0.95, None, 0), ("-", 0.95, None, 0), ("OA", 0.9, 0.9, 0), ("POLISI", 0.9, 0.9, 0),
]


def test_status(spark):
    df = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(STATUS)], "i int, plate string, c double, q double")
    got = {r["i"]: r["s"] for r in df.select("i", P.status(F.col("plate"), F.col("c"), F.col("q")).alias("s")).collect()}
    assert [got[i] for i in range(len(STATUS))] == [s[3] for s in STATUS]


def test_leading_zeros_and_display(spark):
    r = _texts(spark, ["B0123CD"]).select(P.correct(F.col("text")).alias("r"), P.display(F.lit("ab1234cd")).alias("d"), P.region_code(F.lit("RI12")).alias("g")).first()
    assert (r["r"]["corrected"], r["r"]["valid"], r["r"]["penalty"], r["d"], r["g"]) == ("B123CD", True, 0.1, "AB 1234 CD", "RI")


@pytest.mark.parametrize(
    ("readings", "text", "valid", "stable"),
    [
        ([("B1234CD", 0.75, 0.35), ("B1234CE", 0.95, 0.35), ("B1234CD", 0.70, 0.95)], "B1234CD", True, True),
        ([("B1234CD", 0.99, 1.0)], "B1234CD", True, False),
        ([("B1234CD", 0.99, 0.9), ("B1234CDX", 0.80, 0.9)], "B1234CD", True, False),
        ([("B1234CD", 0.75, 0.35), ("B1234CE", 0.90, 0.40), ("B1234CD", 0.85, 0.95)], "B1234CD", True, True),
        ([("B1234CD", 0.70, 0.50), ("B9999ZZ", 0.70, 0.50)], None, True, False),
    ],
)
def test_votes(spark, readings, text, valid, stable):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(readings)], "track_id int, reading_id int, text string, confidence double, crop_quality double")
    v = votes(df).first()
    assert (text is None or v["text"] == text) and v["valid"] == valid and v["stable"] == stable and v["total"] == len(readings)
    if len(readings) == 3:
        assert v["consensus"] > 0.8 and v["crop_quality"] == 0.95 and v["confidence"] < 0.95


def test_best_valid_candidate(spark):
    df = spark.createDataFrame([(1, [("81234CD", 0.99), ("B1234CD", 0.89), ("B1234CE", 0.5)])], "capture_id int, candidates array<struct<text:string,confidence:double>>")
    assert best_valid(df).first()["text"] == "B1234CD"


def test_recurrence_labels(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 6)], "n int")
    rows = df.select(P.vehicle_recurrence(F.col("n"), F.lit(True)).alias("v"), P.person_recurrence(F.col("n")).alias("p")).collect()
    assert [r["v"] for r in rows] == ["NORMAL", "NORMAL", "SERING_MUNCUL", "SERING_MUNCUL", "MENCURIGAKAN"]
    assert [r["p"] for r in rows] == ["MENCURIGAKAN", "NORMAL", "SERING_MUNCUL", "SERING_MUNCUL", "MENCURIGAKAN"]


def test_identities(spark):
    df = spark.createDataFrame([("person:1:grp_2:x", 5), (" ", 5), ("other", None), ("other", 7)], "k string, t long")
    assert [r[0] for r in df.select(P.person_identity(F.col("k"), F.col("t"))).collect()] == ["grp_2", "track:5", "other", "track:7"]
    one = spark.range(1).select(P.vehicle_identity(F.lit(None).cast("string"), F.lit("vehicle:1:9:gen2"), F.lit(3), F.lit(4)).alias("i")).first()
    assert one["i"] == "cam4_vehicle:1:9"


@pytest.mark.parametrize(
    ("text", "formatted", "known"),
    [("B2750TRO", "B 2750 TRO", True), ("AB 1618 SI", "AB 1618 SI", True), ("P4712Y", "P 4712 Y", True), ("1480 HK", "1480 HK", False), ("8 2750 TRO", "B 2750 TRO", True), ("AR 1618 SI", "AB 1618 SI", True)],
)
def test_segments(spark, text, formatted, known):
    r = spark.range(1).select(P.segment(F.lit(text)).alias("s")).first()["s"]
    assert (r["formatted"], r["known"], r["valid"]) == (formatted, known, True)


def test_tax_dates(spark):
    df = _texts(spark, ["08.28", "11-27", "05 26", ".28", "0828", "1399", "B12", "0819"])
    assert [r[0] for r in df.select(P.is_tax_date(F.col("text"))).collect()] == [True] * 5 + [False] * 3


def test_fragments(spark):
    from gatewatch.operators.votes import merged_fragments

    rows = [(1, "2750", 30.0, 1.0, 0.9), (1, "B", 0.0, 0.0, 0.8), (1, "TRO", 60.0, 2.0, 0.7), (1, "08.28", 20.0, 40.0, 0.99), (2, "XX", 0.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "group_id int, text string, x double, y double, confidence double")
    assert {r["group_id"]: r["text"] for r in merged_fragments(df).collect()} == {1: "B2750TRO", 2: "XX"}
