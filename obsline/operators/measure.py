"""Measures of decoded frames P2-P7: Arrow batches of pixels in, a few numbers out, before any shuffle.

Frames are (stream_id, observation_id, pixels BINARY, height, width), three bytes a pixel (blue, green, red),
row by row, cut to the board. Rows whose bytes do not fit height x width give nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["stream_id", "observation_id"]
#: Frames whose measures are held at once, and bytes of a batch that Spark sends to Python.
AT_ONCE, BATCH_BYTES = 64, 8 << 20


class _Frame(NamedTuple):
    pixels: bytes | None
    height: int | None
    width: int | None


def _image(row) -> np.ndarray | None:
    if row.pixels is None or not row.height or not row.width or len(row.pixels) != row.height * row.width * 3:
        return None
    return np.frombuffer(row.pixels, np.uint8).reshape(int(row.height), int(row.width), 3).astype(float)


def _cells(plane: np.ndarray) -> np.ndarray:
    """(64, h, w): the cells of a picture, cell 0 at the bottom left; all of one size, each from its own edge."""
    h, w = (max(n // 8, 1) for n in plane.shape)
    ys, xs = (np.minimum(np.linspace(0, n, 9)[:8].astype(int)[:, None] + np.arange(m), n - 1) for n, m in zip(plane.shape, (h, w), strict=True))
    return plane[ys[::-1, None, :, None], xs[None, :, None, :]].reshape(64, h, w)


def cell_means(gray: np.ndarray, margin: float = 0.15) -> np.ndarray:
    """Mean of each of 64 cells inside its margins."""
    cells = _cells(gray)
    my, mx = (int(n * margin) for n in cells.shape[1:])
    return cells[:, my : cells.shape[1] - my, mx : cells.shape[2] - mx].mean(axis=(1, 2))


def corner_means(plane: np.ndarray, share: float = 0.12) -> np.ndarray:
    """(64, 4): mean of the four corner patches of each cell, a patch of 12 per cent, two pixels at least, 45 per cent at most."""
    cells = _cells(plane)
    h, w = (int(min(max(n * share, 2), max(n * 0.45, 1))) for n in cells.shape[1:])
    corners = (cells[:, :h, :w], cells[:, :h, -w:], cells[:, -h:, :w], cells[:, -h:, -w:])
    return np.stack([c.mean(axis=(1, 2)) for c in corners], axis=1)


def edge_ratios(gray: np.ndarray, bright: float = 200) -> np.ndarray:
    """(64, 4): share of bright pixels along the four edges of each cell."""
    cells = _cells(gray) > bright
    return np.stack([c.mean(axis=1) for c in (cells[:, 0], cells[:, -1], cells[:, :, 0], cells[:, :, -1])], axis=1)


def measure_frames(frames: DataFrame, over: float = 35) -> DataFrame:
    """P2-P5 in one pass: cells (64 means), highlight (64), red corners (64 x 4) and edges (64 x 4).

    red_threshold is the frame's median corner plus ``over``, or midway to its greatest if that is less.
    """

    names = ["cells", "highlight", "red", "edges"]

    def measures(row) -> tuple[list[np.ndarray], float] | None:
        image = _image(row)
        if image is None:
            return None
        b, g, r = image[..., 0], image[..., 1], image[..., 2]
        gray = 0.114 * b + 0.587 * g + 0.299 * r
        red = corner_means(r - (g + b) / 2)
        base, top = float(np.median(red)), float(red.max())
        found = [cell_means(gray), corner_means(np.minimum(r, g) - b).mean(axis=1), red.ravel(), edge_ratios(gray).ravel()]
        return found, min(base + over, max((base + top) / 2, base + 1))

    def part(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [measures(_Frame(*(rows.column(n)[i].as_py() for n in ("pixels", "height", "width")))) for i in range(rows.num_rows)]
        lists = []
        for k in range(len(names)):
            ends = np.cumsum([0, *(0 if f is None else len(f[0][k]) for f in found)])
            starts = pa.array(ends, pa.int32(), mask=np.array([*(f is None for f in found), False]))
            lists.append(pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.empty(0), *(f[0][k] for f in found if f is not None)]))))
        cut = pa.array([None if f is None else f[1] for f in found], pa.float64())
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in KEYS), *lists[:3], cut, lists[3]], names=[*KEYS, *names[:3], "red_threshold", names[3]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                yield part(batch.slice(start, AT_ONCE))

    # Batches are bounded by bytes, as a row is a picture.
    frames.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.select(*KEYS, "pixels", "height", "width").mapInArrow(
        run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", cells array<double>, highlight array<double>, red array<double>, red_threshold double, edges array<double>")


def red_cells(measured: DataFrame) -> DataFrame:
    """Cells of which three corners exceed the frame's red_threshold, ascending."""
    over = F.transform("red", lambda x: (x > F.col("red_threshold")).cast("int"))
    hits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(F.slice(over, i * 4 + 1, 4), F.lit(0), lambda a, x: a + x))
    return measured.withColumn("red_cells", F.array_compact(F.transform(hits, lambda n, i: F.when(n >= 3, i))))


def hover_flag(measured: DataFrame, visible: float = 0.10, strong: float = 0.65) -> DataFrame:
    """P5: cells of which two edges are visible, or one strongly."""
    flags = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.size(F.filter(F.slice("edges", i * 4 + 1, 4), lambda x: x > visible)) >= 2)
                        | (F.array_max(F.slice("edges", i * 4 + 1, 4)) > strong))
    return measured.withColumn("hover_cells", F.array_compact(F.transform(flags, lambda f, i: F.when(f, i))))


def bright_regions(frames: DataFrame, bright: float = 200) -> DataFrame:
    """P6 and P7 measures: bright pixels and their share in the regions ``top`` and ``bottom`` (one byte a pixel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def count(p) -> int:
            return 0 if p is None else int((np.frombuffer(p, np.uint8) > bright).sum())

        for pdf in batches:
            out = pdf[KEYS].copy()
            for side in ("top", "bottom"):
                out[f"{side}_bright"] = [count(p) for p in pdf[side]]
                out[f"{side}_ratio"] = [count(p) / len(p) if p is not None and len(p) else None for p in pdf[side]]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.select(*KEYS, "top", "bottom").mapInPandas(
        run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", top_bright long, top_ratio double, bottom_bright long, bottom_ratio double")


def active_side(regions: DataFrame, least: int = 50) -> DataFrame:
    """Top, bottom or none; a tie goes to top. P7: the difference of the shares."""
    side = F.when((F.col("top_bright") < least) & (F.col("bottom_bright") < least), "none").when(F.col("top_bright") >= F.col("bottom_bright"), "top").otherwise("bottom")
    return regions.withColumn("active_side", side).withColumn("bright_delta", F.col("top_ratio") - F.col("bottom_ratio"))
