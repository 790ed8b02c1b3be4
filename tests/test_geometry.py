"""Clipping, zones and polygon checks against plain geometry."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import geometry as G

SCHEMA = "i long, x1 double, y1 double, x2 double, y2 double, p array<array<double>>"


def shoelace(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2


def hull(points):
    points = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(points) + half(points[::-1])


def common_area(p, box):
    """Of a convex polygon and a box: the hull of the corners of each in the other and of where their edges cross."""
    x1, y1, x2, y2 = box
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    inside = lambda q: all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= -1e-12 for a, b in zip(p, p[1:] + p[:1]))
    found = [q for q in corners if inside(q)] + [q for q in p if x1 <= q[0] <= x2 and y1 <= q[1] <= y2]
    for a, b in zip(p, p[1:] + p[:1]):
        for axis, limit in ((0, x1), (0, x2), (1, y1), (1, y2)):
            if (a[axis] - limit) * (b[axis] - limit) < 0:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                q = (limit, a[1] + t * (b[1] - a[1])) if axis == 0 else (a[0] + t * (b[0] - a[0]), limit)
                if x1 <= q[0] <= x2 and y1 <= q[1] <= y2:
                    found.append(q)
    return shoelace(hull(found)) if len(set(found)) > 2 else 0.0


def test_clipping_of_convex_polygons(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        p = hull([(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(r.randrange(3, 9))])
        x, y = r.uniform(-2, 9), r.uniform(-2, 9)
        rows.append((i, x, y, x + r.uniform(0.1, 8), y + r.uniform(0.1, 8), [list(q) for q in p]))
    got = {x["i"]: x["a"] for x in spark.createDataFrame(rows, SCHEMA).select("i", G.clip_area(G.box(), F.col("p")).alias("a")).collect()}
    areas = [common_area([tuple(q) for q in p], b) for _, *b, p in rows]
    assert max(abs(got[i] - a) for i, a in enumerate(areas)) < 1e-9 and sum(a > 0 for a in areas) > 200


def test_clipping_of_a_polygon_with_a_dent(spark):
    u = [[0.0, 0.0], [6.0, 0.0], [6.0, 4.0], [4.0, 4.0], [4.0, 1.0], [2.0, 1.0], [2.0, 4.0], [0.0, 4.0]]
    rows = [(0, 1.0, 2.0, 5.0, 6.0, u), (1, 0.0, 0.0, 6.0, 4.0, u), (2, 2.5, 2.0, 3.5, 3.0, u), (3, 7.0, 7.0, 8.0, 8.0, u), (4, -1.0, -1.0, 9.0, 9.0, u[::-1])]
    got = [x["a"] for x in spark.createDataFrame(rows, SCHEMA).orderBy("i").select(G.clip_area(G.box(), F.col("p")).alias("a")).collect()]
    assert got == pytest.approx([4.0, 18.0, 0.0, 0.0, 18.0])


def test_zones_by_each_rule(spark):
    """A quarter of the box; a third of the zone under a large box; a fifth of the box with its foot inside; no more otherwise."""
    near = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    boxes = [(7.5, 0, 17.5, 10), (7.6, 0, 17.6, 10), (-40, -40, 60, 60), (-40, -40, 60, 2), (4, -30, 6, 9), (4, -31, 6, 8), (4, -35, 6, 8), (4, 1, 6, 40), (5, 5, 5, 9), (20, 20, 30, 30)]
    rows = [(i, *map(float, b), near) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [x[0] for x in df.orderBy("i").select(G.in_zone(G.box(), F.col("p"))).collect()]
    assert got == [True, False, True, False, True, True, False, False, False, False]
    assert [x[0] for x in df.orderBy("i").limit(2).select(G.zone_of(G.box(), F.col("p"), F.lit(None).cast("array<array<double>>"))).collect()] == ["NEAR", "FAR"]
    assert df.select(G.in_zone(G.box(), F.slice("p", 1, 2)).alias("v")).agg(F.every("v")).first()[0]  # no zone to speak of


def test_polygon_problems(spark):
    star = [[0.5 + 0.4 * math.cos(k * 4 * math.pi / 5), 0.5 + 0.4 * math.sin(k * 4 * math.pi / 5)] for k in range(5)]
    cases = [
        ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], None), ([[0.0, 0.0], [0.5, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], None), ([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], None),
        ([[0.0, 0.0], [1.0, 1.0]], "too few points"), ([[0.0, 0.0], [1.2, 0.0], [1.0, 1.0]], "out of range"), ([[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0]], "crosses itself"), (star, "crosses itself"),
        ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.5, 0.0], [0.0, 1.0]], "crosses itself"),  # touches an edge with a corner
        ([[0.0, 0.0], [1.0, 0.0], [0.5, 0.0], [0.5, 1.0]], "crosses itself"),  # turns back on itself
        ([[0.0, 0.0], [0.4, 0.4], [0.8, 0.0], [0.8, 0.8], [0.4, 0.4], [0.0, 0.8]], "crosses itself"),  # comes by the same point twice
        ([[0.2, 0.2], [0.2, 0.2], [0.2, 0.2]], "crosses itself"), ([[0.0, 0.0], [0.05, 0.0], [0.0, 0.05]], "too small"), ([[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.5, 0.3], [0.1, 0.9]], None),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i long, p array<array<double>>")
    assert [x[0] for x in df.orderBy("i").select(G.polygon_problem(F.col("p"))).collect()] == [w for _, w in cases]
