"""State machines in Structured Streaming with typed state: values, tables by key, and timers in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from obsline.streaming.machines import Entries
from obsline.streaming.run import STREAM, Held, _rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "waiting"


def changes(before: dict[tuple, tuple], after: dict[tuple, tuple]) -> tuple[dict[tuple, tuple], list[tuple]]:
    """The entries to write and the keys to remove."""
    return {k: v for k, v in after.items() if k not in before or before[k] != v}, [k for k in before if k not in after]


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(", ")] if schema else []


class Processor(StatefulProcessor):
    """One machine for each stream. A call reads the stream's state, takes rows or a timer, and writes what has changed."""

    def __init__(self, machine: Callable[[], Any], row: StructType, idle: float):
        self.machine, self.row, self.idle = machine, row, idle
        self.names = [STREAM, *_names(machine().SCHEMA)]
        self.values = _names(machine().VALUES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = self.machine()
        kinds = ", ".join(filter(None, ("last double, due long, counted long", own.VALUES)))
        self.single = handle.getValueState("single", kinds)
        self.tables = {name: handle.getMapState(name, *kinds) for name, kinds in own.TABLES.items()}
        self.tables[WAITING] = handle.getMapState(WAITING, "ts double, observation_id long, n long", self.row)

    def _stored(self) -> tuple[tuple | None, Entries]:
        single = tuple(self.single.get()) if self.single.exists() else None
        return single, {name: {tuple(k): tuple(v) for k, v in table.iterator()} for name, table in self.tables.items()} if single else {n: {} for n in self.tables}

    def _call(self, key: tuple, fresh: list[dict], mark: float, timer: bool) -> Iterator[pd.DataFrame]:
        single, before = self._stored()
        machine = self.machine()
        last, due, counted = single[:3] if single else (None, None, 0)
        if single:
            for name, value in zip(self.values, single[3:], strict=True):
                setattr(machine, name, value)
            machine.load(before)
        fields = self.row.names
        waiting = {k: dict(zip(fields, v, strict=True)) for k, v in before[WAITING].items()}
        for row in fresh:
            waiting[row["ts"], row["observation_id"], counted] = row
            counted += 1
            last = row["ts"] if last is None else max(last, row["ts"])
        held = Held(machine)
        order = sorted(waiting, key=lambda k: (k[0], k[1] is not None, k[1] or 0, k[2]))
        held.rows.extend(waiting[k] for k in order)
        out = held.until(mark)
        left = order[len(order) - len(held.rows) :]
        if timer and not left and last is not None and mark >= last + self.idle:
            out += machine.finish()
            if due is not None:
                self.handle.deleteTimer(due)
            self.single.clear()
            for name, table in self.tables.items():
                if before[name]:
                    table.clear()
        else:
            after = {**machine.dump(), WAITING: {k: tuple(waiting[k][f] for f in fields) for k in left}}
            for name, table in self.tables.items():
                put, gone = changes(before[name], after[name])
                for k, v in put.items():
                    table.updateValue(k, v)
                for k in gone:
                    table.removeKey(k)
            next_due = max(int((left[0][0] + machine.LOOK if left else last + self.idle) * 1000), int(mark * 1000)) + 1
            if next_due != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(next_due)
            now = (last, next_due, counted, *(getattr(machine, name) for name in self.values))
            if now != single:
                self.single.update(now)
        yield pd.DataFrame([{STREAM: key[0], **r} for r in out], columns=self.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [row for pdf in rows for row in _rows(pdf)]
        yield from self._call(key, fresh, timerValues.getCurrentWatermarkInMs() / 1000, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._call(key, [], timerValues.getCurrentWatermarkInMs() / 1000, True)

    def close(self) -> None:
        pass


def typed_stream(df: DataFrame, machine: Callable[[], Any], idle: float) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = df.schema[STREAM].dataType.simpleString()
    return df.groupBy(STREAM).transformWithStateInPandas(
        Processor(machine, df.schema, idle), f"{STREAM} {kind}, {machine().SCHEMA}", "Append", "EventTime")
