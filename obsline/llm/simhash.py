"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 1).

Two 64-bit fingerprints at distance 2r share a point at distance r of both. So every distinct
fingerprint emits all variants within r, variants are shuffled, and fingerprints that meet on one are
linked. All that meet on a variant are within 2r of each other, so a star to the least of them links
as much as all pairs would; it holds at most 65 of them for r = 1, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsline.llm.common import connected_components, materialise, small_batches, text_bytes

WORDS = 3
RADIUS = 2
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text's word shingles (bytes.lower and bytes.split know ASCII alone)."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
        n = 1
    else:
        n = len(found) - words + 1
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (signed 64-bit) for each row; null text counts as empty, whose fingerprint is zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at most ``radius`` bits apart, enough to connect all such.

    ``radius`` must be even: only then are all that meet on a variant within it.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    ball = [0]
    for _ in range(half):
        ball = sorted({v ^ (1 << i) for v in ball for i in range(64)} | set(ball))
    signed = [v - (1 << 64) if v >> 63 else v for v in ball]
    variants = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(v)) for v in signed])).alias("variant"))
    meet = Window.partitionBy("variant").orderBy("fp")
    return (
        variants.withColumn("a", F.first("fp").over(meet)).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), one row for each input row.

    Copies share a fingerprint and meet once, by a grouped minimum. Empty and null texts have
    fingerprint zero and link like others. Null ids stay and never become a component's id unless it
    has no other. An empty table gives an empty result. Other columns are not read.
    """
    marked = materialise(fingerprints(docs, words))
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(ball_links(nodes.select("fp"), radius))
    groups = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    names = groups.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = groups.join(names, "part").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
