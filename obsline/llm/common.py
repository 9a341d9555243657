"""Helpers shared by the corpus operators: tables, shared folder, batches, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts are large, so the default of 10,000 rows would be too much.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of text rows small enough for a worker's memory.

    Spark reads this setting when a query runs, not when it is built, so it has to stay in the session;
    a smaller limit that the session brings is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose binary column has ``most`` bytes or less (a longer value is taken alone)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


# ---- what classic sessions alone offer: the folder of setCheckpointDir, deletion, the driver's garbage

def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of write_shared once a later table stands for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def collect_garbage(spark: SparkSession) -> None:
    """Ask the driver to collect garbage: Spark removes shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


# ---- the shared folder

def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint directory, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/obsline-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, *partition_by: str) -> str:
    """Write to a new shared folder and return its path."""
    path = shared_dir(df.sparkSession)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


#: Folders of materialise, one list for each open scratch block.
_OPEN: list[list[str]] = []


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors.

    The folder stays, as the result may be read at any time, unless this happens in a scratch block.
    """
    path = write_shared(df, *partition_by)
    for paths in _OPEN[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialise writes within the block goes at its end: for steps whose results are written before that."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            discard(spark, path)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text gives the fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: (node, component), component the least node reachable.

    Alternating large-star and small-star rounds: every round is a grouped minimum (combined before
    the shuffle) and an equi join whose hot keys AQE may split; no neighbourhood is ever collected.
    Each round is written to the shared folder, where it takes the place of the one before. Nulls and loops are ignored; nodes without an edge
    do not appear. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession

    def ordered(df: DataFrame, x: Column, y: Column) -> DataFrame:
        return df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    kind = both.schema["x"].dataType.simpleString()

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = write_shared(df)
        return spark.read.schema(df.schema).parquet(path), path

    star, path = written(ordered(both, F.col("x"), F.col("y")))
    seen = mark(star)
    if not seen[0]:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    while True:
        # Large star: neighbours above a node move to the least node of its neighbourhood.
        arcs = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ordered(arcs.join(least, "u").filter("v > u"), F.col("v"), F.col("m"))
        # Small star: a node and its neighbours below it move to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
        before, (star, path) = path, written(ordered(small, F.col("u"), F.col("v")))
        discard(spark, before)
        now = mark(star)
        if now == seen:
            break
        seen = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
