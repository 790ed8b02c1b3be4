"""The n-gram Jaccard join against all pairs, its cuts and costs, and odd tables."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import jaccard
from gatewatch.llm.common import table

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(rows, percent=90):
    """(doc_id, n, component) of all rows, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


def edited(words, r, n):
    """n words changed, dropped or added at random places."""
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        match r.randrange(3):
            case 0:
                words[at] = f"new{r.randrange(9999)}"
            case 1:
                del words[at]
            case _:
                words.insert(at, f"more{r.randrange(9999)}")
    return words


@pytest.fixture(scope="module")
def rows():
    """Texts of 1 to 900 words, most with copies whose edits lie about the threshold."""
    r = random.Random(5)
    out = []
    for k in range(60):
        size = r.choice([1, 2, 3, 4, 8, 12, 20, 35, 60, 120, 300, 900])
        base = [f"w{r.randrange(30 if k % 7 == 0 else 5000)}" for _ in range(size)]
        out.append(base)
        for _ in range(r.randrange(6)):
            out.append(edited(base, r, max(0, round(size * r.choice([0, 0.01, 0.015, 0.02, 0.05])) if size > 20 else r.randrange(2))))
            if not out[-1]:
                out.pop()
    return [(i, r.choice([" ", "\n", "\t "]).join(w).upper() if i % 5 == 0 else " ".join(w)) for i, w in enumerate(out)]


def test_against_all_pairs(spark, rows):
    assert got(jaccard.joined(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


@pytest.mark.parametrize("share", [0.3, 1.0])
def test_one_deletion_neighbourhoods(spark, rows, share):
    """Other allocations find the same links."""
    cut = jaccard.bands({}, 90)
    for j, (equal, near) in enumerate(zip(cut.equal, cut.near)):
        most = int(equal + 2 * near)  # the budget that the segments must reach
        cut.near[j] = min(round(most * share / 2 + 0.5), -(-most // 2)) if most else 0
        cut.equal[j] = max(0, most - 2 * cut.near[j])
    assert cut.near.sum() > 0 and got(jaccard.joined(spark.createDataFrame(rows, SCHEMA), cut=cut)) == expected(rows)


@pytest.mark.parametrize("percent", [60, 80])
def test_other_thresholds(spark, rows, percent):
    assert got(jaccard.joined(spark.createDataFrame(rows, SCHEMA), percent)) == expected(rows, percent)


def test_a_signature_is_shared_whatever_differs():
    """Sets at the very limit of size and difference share a signature under any allocation; costs choose either kind."""
    r = np.random.default_rng(3)
    chosen = set()
    for number in (1.0, 1e4, 1e10):
        sizes = {s: number for s in range(5, 700)}
        cut = jaccard.bands(sizes, 90, 1000)
        for size in [*range(5, 60), 100, 333, 600]:
            a = r.integers(0, 2**63, size).astype(np.uint64)
            for n in range(size, size * 100 // 90 + 1):
                most = jaccard.most_different(size, n, 90)
                lost = (most - (n - size)) // 2
                if lost < 0 or most == 0:
                    continue
                b = np.concatenate([a[lost:], r.integers(0, 2**63, n - size + lost).astype(np.uint64)])
                whose, what = jaccard.signatures([a, b], cut)
                assert set(what[whose == 0]) & set(what[whose == 1]), (number, size, n)
        chosen |= {(bool(e), bool(n)) for e, n in zip(cut.equal, cut.near) if e + n}
    assert {(True, False), (False, True)} <= chosen


def test_bands_cover_every_link():
    cut = jaccard.bands({}, 90)
    for a in [*range(1, 3000), 12345, 10**7]:
        assert 0 <= cut.of(np.array([a * 100 // 90]))[0] - cut.of(np.array([a]))[0] <= 1


def test_odd_rows(spark, tmp_path):
    """Null, empty, blank, tiny and very long texts, repeated rows and ids, null ids, other white space, clashing columns."""
    r = random.Random(7)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    base = [f"x{i}" for i in range(200)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0btwo"), (8, "one\xa0two"), (9, "one two three"), (9, "one two three"), (9, "something else altogether here"), (None, "one two three"), (None, "only mine"), (None, None)]
    rows += [(10, long), (11, long + " end"), (12, " ".join(base)), (13, " ".join([*base, "y"])), (13, " ".join([*base, "y", "z"])), (0, "É é É"), (14, "é É é")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(0), "node": F.lit("mine"), "key": F.lit("own"), "bucket": F.lit(1), "signatures": F.lit(2)})
    assert got(jaccard.joined(df)) == expected(rows)
    empty = jaccard.joined(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(jaccard.op12_jaccard_join(spark, str(tmp_path))) == expected(rows)


def test_large_groups(spark):
    """Thousands of repeated rows of two near copies, and hundreds of copies with edits of their own, which link in chains only."""
    base = [f"w{i}" for i in range(300)]
    near = " ".join([*base[:299], "other"])
    rows = [(i, " ".join(base) if i % 2 else near) for i in range(3000)] + [(1, " ".join(base))] * 1000
    r = random.Random(9)
    rows += [(10_000 + i, " ".join(edited([f"v{k}" for k in range(120)], r, 3))) for i in range(150)]
    want = expected([*rows[:2], *rows[4000:]])
    have = got(jaccard.joined(spark.createDataFrame(rows, SCHEMA)))
    assert len(have) == 4150 and {x[2] for x in have if x[0] < 10_000} == {0}
    assert sorted((x for x in have if x[0] >= 10_000), key=str) == [x for x in want if x[0] >= 10_000]


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert got(jaccard.op12_jaccard_join(spark, sf)) == expected(rows)
