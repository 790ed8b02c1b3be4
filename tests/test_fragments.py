"""Pieces of text put together, against a walk over each group."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import plates as P
from gatewatch.operators import votes

SCHEMA = "group_id long, place long, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def pieces(seed, groups=150):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        for k in range(r.choice([1, 1, 2, 3, 4, 6])):
            x, y, h = r.randrange(0, 200, 20), r.choice([0, 3, 10, 40, 60]), r.choice([8, 20, 22, 30])
            box = (float(x), float(y), float(x + 30), float(y + h)) if r.random() < 0.9 else (None,) * 4
            out.append((g, k, r.choice(["B", "1234", "CD", "B 1234 CD", "D77X", "08.28", "12-27", "28", "xx yy", "  ", None, "POLRI", "8 I23 4"]), r.choice([0.1, 0.2, 0.5, 0.8, 0.95]), *box))
    return out


def lines_of(rows):
    """group -> its lines as (joined text, confidences, heights), whether it is alone; tax dates as the column tells them."""
    out = {}
    for g in sorted({r[0] for r in rows}):
        items = []
        for _, k, text, score, x1, y1, x2, y2, tax in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            text = (text or "").strip(" ")
            if score < 0.2 or not text:
                continue
            known = x1 is not None
            items.append({"t": text, "s": score, "x": x1 if known else 0.0, "y": (y1 + y2) / 2 if known else 0.0, "h": max(1.0, y2 - y1) if known else 0.0, "tax": tax})
        if not items:
            continue
        kept = items
        if len(items) > 1:
            tall, top = max(i["h"] for i in items), min(i["y"] for i in items)
            kept = []
            for i in items:
                c = re.sub("[^A-Z0-9]", "", i["t"].upper())
                low = i["y"] - top > max(8.0, tall * 0.5)
                if not (i["tax"] or (low and (c.isdigit() or len(c) <= 3)) or (tall > 0 and i["h"] <= 0.6 * tall and low)):
                    kept.append(i)
            kept = kept or items
        lines = []
        for i in sorted(kept, key=lambda i: i["y"]):
            for line in lines:
                if abs(i["y"] - sum(x["y"] for x in line) / len(line)) <= max(4.0, 0.4 * sum(x["h"] for x in line) / len(line)):
                    line.append(i)
                    break
            else:
                lines.append([i])
        out[g] = len(items) == 1, [(" ".join(x["t"] for x in sorted(line, key=lambda x: x["x"])), [x["s"] for x in line], [x["h"] for x in line]) for line in lines]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    rows = pieces(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    tax = {r["text"]: r["tax"] for r in df.select("text").distinct().select("text", P.is_tax_date(F.trim("text")).alias("tax")).collect()}
    lines = lines_of([(*r, bool(tax[r[2]])) for r in rows])
    texts = sorted({t for _, found in lines.values() for t, _, _ in found})
    cut = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.segment(F.col("t")).alias("s")).collect()}
    want = {}
    for g, (alone, found) in lines.items():
        text, scores, _ = max(found, key=lambda f: (30.0 if cut[f[0]]["known"] else 15.0 if cut[f[0]]["valid"] else 0.0) + sum(f[1]) + sum(f[2]))
        s = cut[text]
        want[g] = (s["text"] if s["valid"] else text if alone else re.sub("[^A-Z0-9]", "", text.upper()), s["formatted"] if s["valid"] else text, round(sum(scores) / len(scores), 9), s["known"])
    got = {r["group_id"]: (r["text"], r["formatted"], round(r["confidence"], 9), r["known"]) for r in votes.merged_boxes(df.repartition(3)).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 20


def test_no_pieces(spark):
    assert votes.merged_boxes(spark.createDataFrame([], SCHEMA)).count() == 0
