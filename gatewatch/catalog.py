"""Every query by name, with the SQL that gives the same rows. Names begin with the operator's group and number."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import cte

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = ("scans", "listings", "joins", "aggregates", "windows", "changes", "scalars", "streams")
_found: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: De-duplicated events, alone and with their plates, for oracles.
EVENTS = """, dedup as (select * exclude rn from (select *, row_number() over (partition by camera_id, case when event_key is not null and trim(event_key) <> '' then concat('event:', event_key) else concat('det:', detection_id) end order by detection_confidence desc, detection_id desc) rn from detections) where rn = 1),
ev as (select d.*, p.plate_number, p.ocr_confidence, p.detection_status as plate_status from dedup d left join plates p using (plate_id))
"""


def query(name: str, sql: str | None = None, events: bool = False) -> Callable[[Query], Query]:
    """Registers a query; its SQL, if any, sees the logical tables, and `dedup` and `ev` with events."""

    def register(f: Query) -> Query:
        _found[name] = f
        if sql:
            _sql[name] = cte() + (EVENTS if events else "\n") + (sql if sql.lstrip().startswith(",") else sql)
        return f

    return register


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"{__package__}.plans.{group}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
