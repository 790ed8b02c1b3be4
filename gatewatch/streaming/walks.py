"""Walks over the rows of a key in order with a state of several tables: one class for batch and for streams.

A walk takes rows (`take`) and tells what is over at a time (`expired`), when that will next be so (`due`), and what its state is as
tables of plain tuples (`dump`, `load`). The batch twin keeps the object while it goes through sorted partitions. The stream keeps the
tables in list states of RocksDB and sets one event-time timer a key, for `due`, so that a key without further rows ends, too."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from .folds import fold_batch


def names_of(schema: str) -> list[str]:
    return re.findall(r"(\w+) [\w<>]+", schema)


class Walk:
    """STATES: table name -> DDL. The subclass fills and reads the tables in `dump` and `load`."""

    STATES: dict[str, str] = {}

    def take(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def expired(self, at: float) -> list[dict]:
        """What is given out because nothing may come before `at` any more; forgets what can't matter from then on."""
        return []

    def due(self) -> float | None:
        """From when on `expired` would do something."""
        return None

    def dump(self) -> dict[str, list[tuple]]:
        raise NotImplementedError

    def load(self, tables: dict[str, list[tuple]]) -> None:
        raise NotImplementedError


def walk_batch(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Walk], schema: str) -> DataFrame:
    """What the walks give out, and at the end of each key what is left."""

    def step(state: Walk | None, row: dict) -> tuple[Walk, list[dict]]:
        state = state or make()
        return state, state.take(row)

    return fold_batch(rows, keys, order, step, schema, lambda state: state.expired(float("inf")))


def in_order(rows: Iterator[Row], order: list[str], step: int = 10_000) -> Iterator[dict]:
    """A key's rows of a micro-batch in order. They wait in columns, as a micro-batch may hold any number of them, and become dictionaries by the step."""
    first = next(rows := iter(rows), None)
    if first is None:
        return
    names, parts, rows = list(first.asDict()), [], chain((first,), rows)
    while some := [tuple(r) for r in islice(rows, step)]:
        parts.append(pa.table(dict(zip(names, map(pa.array, zip(*some, strict=True)), strict=True))))
    table = pa.concat_tables(parts, promote_options="permissive")
    del parts
    # the last key of lexsort counts most; equal rows stay as they came
    at = np.lexsort([table[c].to_numpy() for c in reversed(order)])
    for i in range(0, len(at), step):
        yield from table.take(pa.array(at[i : i + step])).to_pylist()


class _Processor(StatefulProcessor):
    def __init__(self, order: list[str], make: Callable[[], Walk], schema: str) -> None:
        self.order, self.make, self.names, self.tables = order, make, names_of(schema), make().STATES

    def init(self, handle) -> None:
        self.handle = handle
        self.states = {name: handle.getListState(name, ddl) for name, ddl in self.tables.items()}
        self.timer = handle.getValueState("timer", "at long")

    def restored(self) -> Walk:
        walk = self.make()
        walk.load({name: [tuple(r) for r in state.get()] if state.exists() else [] for name, state in self.states.items()})
        return walk

    def keep(self, walk: Walk, now: int) -> None:
        for name, rows in walk.dump().items():
            if rows:
                self.states[name].put(rows)
            else:
                self.states[name].clear()
        before = self.timer.get()[0] if self.timer.exists() else 0
        due = walk.due()
        due = 0 if due is None else max(now + 1, int(due * 1000) + 2)  # just past it
        if before != due:
            if before > now:
                self.handle.deleteTimer(before)
            if due:
                self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        walk = self.restored()
        for row in in_order(rows, self.order):
            yield from self.given(walk.take(row))
        self.keep(walk, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        walk, at = self.restored(), expiredTimerInfo.getExpiryTimeInMs()
        yield from self.given(walk.expired(at / 1000))
        self.keep(walk, max(timerValues.getCurrentWatermarkInMs(), at))

    def given(self, found: list[dict]) -> Iterator[Row]:
        for f in found:
            yield Row(**{n: f[n] for n in self.names})

    def close(self) -> None:
        pass


def walk_stream(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Walk], schema: str) -> DataFrame:
    """The same over a stream with a watermark; rows of a micro-batch are taken in order. Needs the RocksDB state store."""
    return rows.groupBy(*keys).transformWithState(_Processor(order, make, schema), schema, "append", "EventTime")
