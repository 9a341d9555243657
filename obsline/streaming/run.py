"""Streaming and stateful operators ST1-ST24: windows, watermarks, and drivers for the state machines."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import takewhile
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import Row as RowType
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from obsline.streaming.machines import Bursts, Limits, Look, Reducer, Sampler, Settle, Throttle, Timeline

STREAM = "stream_id"


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _plain(value: Any) -> Any:
    """Values of a pandas row as Python's own: nested arrays as lists, structs as dictionaries, missing ones as None."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value] if value.dtype == object else value.tolist()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, RowType):
        return _plain(value.asDict())
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value != value or value is pd.NaT:
        return None
    return value.item() if hasattr(value, "item") else value


def _rows(pdf: pd.DataFrame) -> Iterator[dict[str, Any]]:
    names = list(pdf.columns)
    for values in zip(*(pdf[c].tolist() if pdf[c].dtype != object else pdf[c] for c in names), strict=True):
        yield dict(zip(names, map(_plain, values), strict=True))


class Held:
    """Rows in time order that wait until all rows up to ``look`` seconds after them are there."""

    def __init__(self, machine: Any):
        self.machine, self.rows = machine, deque()

    def _first(self) -> list[dict[str, Any]]:
        row = self.rows.popleft()
        if not self.machine.LOOK:
            return self.machine.step(row)
        end = row["ts"] + self.machine.LOOK
        return self.machine.step(row, list(takewhile(lambda r: r["ts"] <= end, self.rows)))

    def until(self, mark: float) -> list[dict[str, Any]]:
        """What the machine says of the rows whose look-ahead ends at ``mark`` or before."""
        out = []
        while self.rows and self.rows[0]["ts"] + self.machine.LOOK <= mark:
            out += self._first()
        return out

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        """The next row in order: rows whose look-ahead ends before it go through, and so does itself if there is none."""
        if not self.machine.LOOK:
            return self.machine.step(row)
        out = []
        while self.rows and self.rows[0]["ts"] + self.machine.LOOK < row["ts"]:
            out += self._first()
        self.rows.append(row)
        return out

    def finish(self) -> list[dict[str, Any]]:
        return self.until(float("inf")) + self.machine.finish()


def run_batch(df: DataFrame, machine: Callable[[], Any], order: tuple[str, ...] = ("ts", "observation_id")) -> DataFrame:
    """A machine over every stream: rows are dealt by stream and sorted, and pass through batch by batch.

    Memory is that of a batch, of the machine's state and of the rows within its look-ahead, however long a stream is. Null
    streams are one; rows without a time are left out.
    """
    schema, kind = machine().SCHEMA, df.schema[STREAM].dataType.simpleString()
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, now, out = object(), None, []
        for pdf in batches:
            for row in _rows(pdf):
                if now is None or row[STREAM] != stream:
                    out += [{STREAM: stream, **r} for r in now.finish()] if now else []
                    stream, now = row[STREAM], Held(machine())
                out += [{STREAM: stream, **r} for r in now.step(row)]
            if out:
                yield pd.DataFrame(out, columns=[STREAM, *names])
                out = []
        if now and (out := [{STREAM: stream, **r} for r in now.finish()]):
            yield pd.DataFrame(out, columns=[STREAM, *names])

    timed = df.filter(F.col("ts").isNotNull())
    return timed.repartition(STREAM).sortWithinPartitions(STREAM, *order).mapInPandas(run, f"{STREAM} {kind}, {schema}")


def run_stream(df: DataFrame, machine: Callable[[], Any], ts: str = "event_time", idle: float = 3600.0) -> DataFrame:
    """The same machine in Structured Streaming (ST2): rows wait in state until the watermark has passed them and the
    machine's look-ahead, by a timer, then go through in order. Rows that come later than the watermark are dropped (ST15; LateRows counts them).

    A stream without rows for ``idle`` seconds before the watermark has ended: its machine finishes, what it still
    holds goes out, and its state is removed. A row that comes later starts the stream anew. Rows without a time are left out.

    State is typed: the waiting rows, the machine's values and each of its tables; a batch writes the entries that have
    changed. It lives in RocksDB, whose provider is set for the session. ``df`` has a watermark on ``ts``. Output mode is append.
    """
    from obsline.streaming.typed import typed_stream

    return typed_stream(df.filter(F.col("ts").isNotNull()), machine, idle)


def chunk_tumbling(df: DataFrame, every: str = "300 seconds", *aggregates: Column) -> DataFrame:
    """ST1: fixed chunks of a stream, batch or streaming."""
    return df.groupBy(STREAM, F.window("ts", every).alias("chunk")).agg(*(aggregates or (F.count("*").alias("n"),))).withColumn(
        "chunk_start", F.col("chunk.start")).withColumn("chunk_end", F.col("chunk.end")).drop("chunk")


def watermarked(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST2."""
    return df.withWatermark("ts", delay)


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST3, coarse form: bursts as session windows."""
    return df.groupBy(STREAM, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        STREAM, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def coalesce_bursts(df: DataFrame) -> DataFrame:
    """ST3, exact: (stream_id, ts seconds, observation_id, has_motion, motion_spike) to emissions."""
    return run_batch(df, Bursts)


def adaptive_sampler(df: DataFrame) -> DataFrame:
    """ST4."""
    return run_batch(df, Sampler)


def settle_hold(df: DataFrame, hold: float = 1.0) -> DataFrame:
    """ST5."""
    return run_batch(df, lambda: Settle(hold=hold))


def pending_endpoint(df: DataFrame) -> DataFrame:
    """ST11."""
    return run_batch(df, lambda: Settle(hold=0.75, retarget=False))


def probe_throttle(df: DataFrame, every: float = 5.0) -> DataFrame:
    """ST12."""
    return run_batch(df, lambda: Throttle(every=every))


def verified_timeline(df: DataFrame) -> DataFrame:
    """ST6-ST10, ST13, ST17, ST20, ST23, ST24: decisions of the reducer."""
    return run_batch(df, Reducer)


def timeline_ahead(df: DataFrame, limits: Limits = Limits(), look: Look = Look()) -> DataFrame:
    """ST6 with its own look-ahead (ST8, ST18): no column of a row has to know what comes after it.

    A streaming ``df`` (with a watermark on event_time) gives the events that a table of the same rows gives.
    """
    return (run_stream if df.isStreaming else run_batch)(df, lambda: Timeline(limits=limits, look=look))


class LateRows(StreamingQueryListener):
    """ST15 in a stream: how many rows each query has dropped because they came after the watermark.

    Register with ``spark.streams.addListener``; ``counts`` is by the query's id, ``progress`` its batches and rows in.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.progress: dict[str, tuple[int, int]] = {}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        found = event.progress
        key = str(found.id)
        self.counts[key] = self.counts.get(key, 0) + sum(o.numRowsDroppedByWatermark for o in found.stateOperators)
        batches, rows = self.progress.get(key, (0, 0))
        self.progress[key] = batches + 1, rows + found.numInputRows

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass


def dedup_observations(df: DataFrame) -> DataFrame:
    """ST14: one row of each id; in a stream within its watermark."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark([STREAM, "observation_id"])
    return df.dropDuplicates([STREAM, "observation_id"])


def late_rows(df: DataFrame) -> DataFrame:
    """ST15, batch form: rows that come (by arrival) after one with a later time."""
    w = Window.partitionBy(STREAM).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("high", F.max("ts").over(w)).filter(F.col("ts") < F.col("high")).drop("high")


def bounded_replay(stream: DataFrame, path: str, checkpoint: str) -> None:
    """ST16: run what there is through a streaming query to Parquet, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def rollback_confirmation(df: DataFrame, look: float = 6.0, mean: float = 4.0, bounce: float = 0.75) -> DataFrame:
    """ST8: flags returns_soon and bounces, by look-ahead over the distance to the active state (column active_diff)."""
    from obsline.operators.joins import lookahead

    later = F.min(F.when(F.col("active_diff") < mean, F.col("us")))
    found = lookahead(df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), look, {"back_at": later})
    return found.withColumn("returns_soon", F.col("back_at").isNotNull() & (F.col("back_at") > F.col("us"))).withColumn(
        "bounces", F.col("returns_soon") & (F.col("back_at") - F.col("us") <= int(bounce * 1e6))).drop("us", "back_at")


def reading_settle(df: DataFrame, wait: float = 4.0) -> DataFrame:
    """ST18: the readings within the wait after each row, cut at the first rollback, with how many agree on their mode."""
    w = Window.partitionBy(STREAM).orderBy("us").rangeBetween(0, int(wait * 1e6))
    timed = df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    stop = F.min(F.when(F.col("rollback"), F.col("us"))).over(w)
    held = timed.withColumn("stop", stop).withColumn("near", F.collect_list(F.struct("us", "reading")).over(w))
    used = F.filter("near", lambda x: (F.col("stop").isNull() | (x["us"] < F.col("stop"))) & x["reading"].isNotNull())
    values = F.transform(used, lambda x: x["reading"])
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda y: y == v)).alias("n"), v.alias("reading")))
    return held.withColumn("settled", F.array_max(counted)).withColumn("samples", F.size(values)).drop("us", "stop", "near")


def reading_backfill(df: DataFrame, limit: int = 180) -> DataFrame:
    """ST19: an unobserved reading takes the same side's next observed one if that is within ``limit`` of the last and plausible."""
    side = Window.partitionBy(STREAM, "side").orderBy("ts", "observation_id")
    # What comes after is what came before in the order turned round: a frame up to its end would be summed anew for each row.
    back = Window.partitionBy(STREAM, "side").orderBy(F.desc("ts"), F.desc("observation_id"))
    after = F.last(F.when(F.col("observed"), F.col("seconds")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    before = F.last(F.when(F.col("observed"), F.col("seconds")), ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, -1))
    fit = (F.abs(before - after) <= limit) & (after <= before + 65)
    return df.withColumn("repaired", F.when(F.col("observed"), F.col("seconds")).when(fit, after).otherwise(before))


def rebase_continuation(df: DataFrame, keep: int = 2, seconds_: float = 12, least: float = 60) -> DataFrame:
    """ST21: of the transitions after a replacement (column replaced_at) at most ``keep``, recent, strong and allowed."""
    fit = (F.col("ts_s") > F.col("replaced_at")) & (F.col("ts_s") - F.col("replaced_at") <= seconds_) & (F.col("score") >= least) & F.col("allowed")
    n = F.row_number().over(Window.partitionBy(STREAM, "replaced_at").orderBy("ts_s", "observation_id"))
    return df.filter(fit).withColumn("n", n).filter(F.col("n") <= keep).drop("n")


def adjacent_alternative(candidates: DataFrame, least: float = 120, end: float = 35, pair: float = 90, seconds_: float = 15) -> DataFrame:
    """ST22: the strongest one-step alternative from the state before the matched one."""
    fit = (F.col("score") >= least) & (F.col("origin") >= end) & (F.col("target") >= end) & (F.col("origin") + F.col("target") >= pair) & (F.col("age") <= seconds_)
    w = Window.partitionBy(STREAM, "observation_id").orderBy(F.desc("score"), "candidate")
    return candidates.filter(fit).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
