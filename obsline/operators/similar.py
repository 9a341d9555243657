"""Similar states (J4, J5) in blocks: cells go to where they are compared, and pairs are never rows.

History is cut into blocks of bounded size. A task holds one block at a time, and observations pass it in batches; what goes on is
the best state of the block for an observation, if it has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from obsline.operators.windows import STREAM
from obsline.sources.shared import shared_path

#: Rows to a block of history: a sixteenth of its group, within these bounds, so that copies of an observation do not grow with the
#: group until it has a million rows.
LEAST, MOST = 4_096, 65_536
#: Pairs that are looked at in one step.
PAIRS = 1 << 20


class Block:
    """States of a group of history, sorted by the cell that tells most; cells are looked at in order of their spread."""

    def __init__(self, cells: np.ndarray, seq: np.ndarray, packed: np.ndarray, cell: float, limit: float, best: bool, radius: int | None, last: int | None):
        self.order = np.argsort(-cells.var(axis=0), kind="stable")
        rows = np.argsort(cells[:, self.order[0]], kind="stable")
        self.columns = np.ascontiguousarray(cells[rows].T)
        self.seq, self.packed = seq[rows], packed[rows]
        self.cell, self.limit, self.best, self.radius, self.last = cell, limit, best, radius, last

    def search(self, cells: np.ndarray, seq: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the observation, seq of its state, difference) of those that have one."""
        first, at = self.order[0], self.columns[self.order[0]]
        rows = np.argsort(cells[:, first], kind="stable")
        columns, seq, packed = np.ascontiguousarray(cells[rows].T), seq[rows], packed[rows]
        out = []
        for start in range(0, len(rows), 64):
            stop = min(start + 64, len(rows))
            lo = np.searchsorted(at, columns[first, start] - self.cell, "left")
            hi = np.searchsorted(at, columns[first, stop - 1] + self.cell, "right")
            for a in range(lo, hi, PAIRS // 64):
                out.append(self._check(columns, seq, packed, start, stop, a, min(a + PAIRS // 64, hi)))
        i, h, diff = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), self.seq[:0], np.empty(0))
        i, h, diff = self._pick(i, h, diff)
        return rows[i], h, diff

    def _pick(self, i: np.ndarray, h: np.ndarray, diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranked = np.lexsort((-h, diff, i) if self.best else (diff, -h, i))
        i, h, diff = i[ranked], h[ranked], diff[ranked]
        head = np.append(True, i[1:] != i[:-1])[: len(i)]
        return i[head], h[head], diff[head]

    def _check(self, columns, seq, packed, start, stop, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.order[1 % len(self.order)]
        near = np.abs(columns[c, start:stop, None] - self.columns[c, None, a:b]) < self.cell
        i, j = np.divmod(np.flatnonzero(near), b - a)
        i, j = i + start, j + a
        # Cells one by one, as most pairs are told apart by a few; the order in time after the first.
        for n, c in enumerate(self.order):
            keep = np.abs(columns[c][i] - self.columns[c][j]) < self.cell
            if n == 0:
                keep &= self.seq[j] < seq[i] - 1
                if self.last is not None:
                    keep &= self.seq[j] >= seq[i] - self.last
            if not keep.all():
                i, j = i[keep], j[keep]
            if not len(i):
                break
        if self.radius is not None and len(i):
            keep = np.ones(len(i), bool)
            for shift in (0, 6, 12, 18):
                keep &= np.abs((packed[i] >> shift & 63) - (self.packed[j] >> shift & 63)) <= self.radius
            i, j = i[keep], j[keep]
        diff = np.zeros(len(i))
        for c in range(len(columns)):  # in the order of the cells, as a sum over a row
            diff += np.abs(columns[c][i] - self.columns[c][j])
        diff /= len(columns)
        keep = diff < self.limit
        return self._pick(i[keep], self.seq[j[keep]], diff[keep])


def sound(cells: Column) -> Column:
    """Cells of which a distance can be taken."""
    return F.coalesce((F.size(cells) > 0) & F.forall(cells, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def best_in_blocks(obs: DataFrame, history: DataFrame, cell: float, limit: float, mode: str, radius: int | None = None, last: int | None = None,
                   least: int | None = None) -> DataFrame:
    """(stream_id, observation_id, seq, h_seq, diff): for each observation its state among the earlier ones of its stream with a key of its own.

    obs: (stream_id, observation_id, seq, cells, key, packed), a row for each key it looks into, history: (stream_id, seq, cells, key, packed). Groups
    of history (stream, key) are cut into blocks by a hash; observations have a copy for each block of their keys, and none for keys without history.
    """
    spark = history.sparkSession
    kind = obs.schema["seq"].dataType.simpleString()
    number = "long" if all(isinstance(d.schema["seq"].dataType, IntegralType) for d in (obs, history)) else "double"
    group = [STREAM, "width", "key"]

    def plain(df: DataFrame, *names: str) -> DataFrame:
        there = F.col(STREAM).isNotNull() & F.col("seq").isNotNull() & sound(F.col("cells"))
        return df.filter(there).select(STREAM, *names, F.col("seq").cast(number).alias("seq"), F.size("cells").alias("width"), "packed", F.col("cells").cast("array<double>").alias("cells"))

    h, o = plain(history, "key"), plain(obs, "observation_id", "key")
    rows = F.least(F.greatest(F.col("n") / 16, F.lit(least or LEAST)), F.lit(MOST))
    # Read back from a file, as its size is known then and a small table is broadcast.
    path = shared_path(spark, "block_sizes")
    h.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.ceil(F.col("n") / rows).cast("int").alias("parts")).write.parquet(path)
    sizes = spark.read.parquet(path)
    held = h.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("seq", "cells"), "parts").cast("int"))
    passing = o.join(sizes, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = ["seq", "packed", "cells"]
    met = held.select(*group, "part", F.lit(0).alias("side"), F.lit(None).cast(obs.schema["observation_id"].dataType).alias("observation_id"), *rest).unionByName(
        passing.select(*group, "part", F.lit(1).alias("side"), "observation_id", *rest))
    group = [*group, "part"]
    # A number of its own, as bytes do not tell how long a block takes, and partitions of few bytes would be put together.
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group, "side")
    limits = (cell, limit, mode == "best", radius, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, block = None, [], None
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            n = batch.num_rows
            new = np.zeros(n, bool)
            for name in (*group, "side"):
                new[1:] |= pc.not_equal(columns[name][1:], columns[name][:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(new).tolist(), n] if n else []
            for a, b in zip(edges, edges[1:], strict=False):
                key = tuple(columns[name][a].as_py() for name in group)
                if key != now:
                    now, waiting, block = key, [], None
                seq, packed = (columns[name][a:b].to_numpy() for name in ("seq", "packed"))
                cells = columns["cells"][a:b].flatten().to_numpy().reshape(b - a, -1)
                if columns["side"][a].as_py() == 0:
                    waiting.append((cells, seq, packed))
                    continue
                if block is None:
                    block, waiting = Block(*(np.concatenate(x) for x in zip(*waiting, strict=True)), *limits), []
                i, h_seq, diff = block.search(cells, seq, packed)
                if len(i):
                    yield pa.RecordBatch.from_arrays([columns[STREAM][a:b].take(pa.array(i)), columns["observation_id"][a:b].take(pa.array(i)), pa.array(seq[i]), pa.array(h_seq), pa.array(diff)],
                                                     names=[STREAM, "observation_id", "seq", "h_seq", "diff"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    found = met.mapInArrow(run, f"{STREAM} {kinds[STREAM]}, observation_id {kinds['observation_id']}, seq {number}, h_seq {number}, diff double")
    order = F.struct("diff", -F.col("h_seq")) if mode == "best" else F.struct(-F.col("h_seq"), "diff")
    one = found.groupBy(STREAM, "observation_id").agg(F.min_by(F.struct("seq", "h_seq", "diff"), order).alias("x"))
    return one.select(STREAM, "observation_id", F.col("x.seq").cast(kind).alias("seq"), F.col("x.h_seq").cast(history.schema["seq"].dataType).alias("h_seq"), "x.diff")
