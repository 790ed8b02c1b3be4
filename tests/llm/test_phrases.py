"""Collocations against plain counting, perfect hashes, and odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import collocations, mph
from gatewatch.llm.common import table

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least=30, longest=4, subsumed=80, limit=2000):
    """(lang, rank, phrase, a, l, r, n, score), counted one by one."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = set()
        for q, a in candidates.items():
            held |= {q[s : s + m] for m in range(2, len(q)) for s in range(len(q) - m + 1) if 100 * a >= subsumed * counts[q[s : s + m]]}
        rows_ = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:limit])]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Texts with phrases of all lengths, parts of longer ones, ties, breaks of every kind and words of any script."""
    r = random.Random(3)
    common = [f"w{i}" for i in range(40)] + ["É", "é", "日本", "x\xa0y", "\x00", "-"]
    phrases = [["new", "york"], ["New", "York", "city"], ["a", "b", "c", "d"], ["c", "d", "e", "f", "g"], ["so", "so"], ["is", "not"]]
    out = []
    for i in range(300):
        words = []
        for _ in range(r.choice([0, 1, 5, 40, 80])):
            words += r.choice(phrases) if r.random() < 0.3 else [r.choice(common)]
            words[-1] += r.choice(["", "", "", ".", ",", "!?", "\n", "\x0b", "\x0c", "\r\n", ":;"])
        out.append((r.choice([" ", "\t", "  "]).join(words), r.choice(["en", "en", "fr", None, "und", "a\tb"])))
    return [*out, (None, "en"), ("", None), (" . ", "en"), ("so so so so " * 20_000, "fr")]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "part": 300, "keep": 2, "fan": 2}])
def test_against_plain_counts(spark, rows, sizes):
    """Also with many blocks, of which a mapper holds two, and parts smaller than a text."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    have, want = got(collocations.top(*collocations.mined(df, **sizes))), expected(rows)
    assert have == want and len(want) > 30 and {len(x[2].split(" ")) for x in want} == {2, 3, 4}


def test_other_limits(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    assert got(collocations.top(*collocations.mined(df, least=10, longest=3, subsumed=50), limit=20)) == expected(rows, 10, 3, 50, 20)


def test_odd_tables(spark, tmp_path, rows):
    """No rows, no candidates, no phrases; repeated rows count each; clashing columns are not read."""
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for few in ([], [(1, None, None)], [(1, "a b c " * 3, "en")], [(1, "a. " * 50, "en")]):
        none = collocations.top(*collocations.mined(spark.createDataFrame(few, SCHEMA)))
        assert none.columns == columns and none.count() == 0
    twice = [*rows[:50], *rows[:50]]
    df = spark.createDataFrame([(1, *r) for r in twice], SCHEMA).withColumns({"n": F.lit(0), "word": F.lit("x"), "key": F.lit("y"), "block": F.lit(2), "phrase": F.lit("mine"), "a": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(collocations.op11_collocations(spark, str(tmp_path))) == expected(twice)


def test_whole_table_and_sql(spark, sf):
    rows = [(r["text"], r["lang"]) for r in table(spark, sf, "documents").collect()]
    have = got(collocations.op11_collocations(spark, sf))
    assert have == expected(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(collocations.ORACLE_SQL["op11_collocations"]).fetchall()) == have


def test_equal_hashes_are_told_apart(spark, rows, monkeypatch):
    """Keys of equal hash are found by their stored keys (in the driver's own process, as a mapper works)."""
    monkeypatch.setattr(collocations, "pair_hash", lambda a, b: (a % 3).astype(np.uint64))
    a, b = np.arange(30) % 10, np.arange(30) // 10
    perfect = mph.PerfectHash.build(collocations.pair_hash(a, b))
    assert perfect.placed == 0
    blocks = collocations.Blocks("unused")
    blocks.held[0] = {"hash": perfect, "n": 30, "a": a, "b": b}
    ask_a, ask_b = np.array([3, 9, 3, 50]), np.array([1, 2, 9, 0])
    found = blocks.find(collocations.pair_hash(ask_a, ask_b), np.zeros(4, np.int64), 1, collocations.same_pair(ask_a, ask_b))
    assert found.tolist() == [13, 29, -1, -1]


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_rows_of_a_sequence_cut_no_phrase(size):
    slots = np.random.default_rng(4).choice([-1, -1, 3, 4, 5], 3000)
    slots[1000:1500] = 7  # longer than a row
    grams = lambda s, k: Counter(tuple(s[i : i + k].tolist()) for i in range(len(s) - k + 1) if (s[i : i + k] >= 0).all())
    for kind in (np.int32, np.int64):
        rows = [np.frombuffer(r["data"][0].as_py(), kind) for r in collocations.runs(slots, kind, size)]
        assert all(sum((grams(r, k) for r in rows), Counter()) == grams(slots, k) for k in (2, 3, 4))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 50_000])
def test_perfect_hashes_are_minimal(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    perfect = mph.PerfectHash.build(keys)
    assert perfect.placed == n and sorted(perfect.slots(keys)) == list(range(n))
    assert perfect.words.nbytes * 8 < 7 * n + 3000  # bits a key
