"""Every query with SQL gives the rows of DuckDB; all others run."""

from __future__ import annotations

import math

import duckdb
import pytest

from gatewatch import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


def _rows(rows):
    return sorted(([_plain(v) for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert _rows(df.select(*columns).collect()) == _rows([tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()])


#: Streams give out what the watermark has passed: rows of their batch twin, if not all of them (groups are numbered otherwise in streams).
TWINS = {
    "ss01_stream_grouping": "ss01_grouping", "ss02_stream_video_identities": "ss02_video_identities", "ss05_stream_tracked_plates": "ss05_tracked_plates",
    "ss09_stream_vehicles": "ss09_vehicles", "ss10_stream_layers": "ss10_people", "ss10_stream_people": "ss10_person_filter", "ss12_stream_improvements": "ss12_improvements", "ss14_stream_fair_schedule": "ss14_fair_schedule",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    """Queries without SQL have rows, each once; what they hold is tested where the operator is."""
    rows = _rows(QUERIES[name](spark, sf).collect())
    assert rows and len({repr(r) for r in rows}) == len(rows)
    if name in TWINS:
        twin = {repr(r) for r in _rows(QUERIES[TWINS[name]](spark, sf).collect())}
        assert {repr(r) for r in rows} <= twin and len(rows) > 0.8 * len(twin)
