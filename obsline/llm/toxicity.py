"""Toxicity by FTRL-proximal logistic regression over hashed word features (operator 6).

Features of a text, each once: words, their stems (first letters), pairs of neighbours and pairs with
one word between. Shards of a bounded sample of labelled rows are fitted side by side, each by FTRL
with rates of its own per coordinate; their weights and squared gradients are averaged with a grouped sum,
and the next round starts from there. L1 leaves a few thousand weights, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.llm.common import held_out, materialise, small_batches, text_bytes

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    bits: int = 22  # hashed features
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    rounds: int = 2  # rounds of averaging
    epochs: int = 2  # passes over a shard in each round
    sample: int = 24_000  # labelled rows that are fitted at most: those with the least hash of their id
    shard_rows: int = 4_000  # rows of a shard, on average
    stem: int = 5  # letters of a stem


class Features:
    """Hashed features of texts; the hashes of words are kept in a bounded table."""

    def __init__(self, bits: int, stem: int, entries: int = 200_000):
        self.shift = np.uint64(64 - bits)
        self.stem, self.entries = stem, entries
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((2, 1024), np.uint64)  # hashes of words and of stems

    def _learn(self, word: bytes) -> int:
        at = self.index[word] = len(self.index)
        if at == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        clean = word.strip(b".,;:!?\"'()[]|*-")
        stem = clean.decode("utf-8", "ignore")[: self.stem].encode()
        self.table[:, at] = xxhash.xxh3_64_intdigest(clean, 1), xxhash.xxh3_64_intdigest(stem, 2)
        return at

    def __call__(self, text: bytes) -> np.ndarray:
        """The features of a text, as often as they occur."""
        if len(self.index) > self.entries:
            self.clear()
        words, index, learn = text.lower().split(), self.index, self._learn
        at = np.array([index[w] if w in index else learn(w) for w in words], np.int64)
        h, stems = self.table[:, at]
        odd, near, apart = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        parts = [h, stems, (h[:-1] * near) ^ (h[1:] + odd), (h[:-2] * apart) ^ (h[2:] + odd)]
        return ((np.concatenate(parts) * odd) >> self.shift).astype(np.int32)


def fit_shard(rows: list[tuple[np.ndarray, int]], start: np.ndarray, squares: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FTRL-proximal over one shard, from weights ``start`` and sums of squared gradients ``squares``.

    Gives the coordinates whose weight is not zero, their weights and squares; the last entry is the intercept.
    """
    size = len(start)
    n = squares.astype(np.float32)
    # z that gives the starting weights
    z = (-start * ((s.beta + np.sqrt(n)) / s.alpha + s.l2) - np.sign(start) * s.l1).astype(np.float32)
    z[-1] = -start[-1] * (s.beta + np.sqrt(n[-1])) / s.alpha
    seen = np.zeros(size, bool)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        w[np.abs(zi) <= s.l1] = 0
        w[-1] = -zi[-1] * s.alpha / (s.beta + np.sqrt(n[i[-1]]))  # no penalty on the intercept
        return w

    for _ in range(s.epochs):
        for features, label in rows:
            i = np.append(features, size - 1)
            w = weights(i)
            g = np.float32(1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
            seen[i] = True
    held = np.flatnonzero(seen)
    held = np.append(held[held < size - 1], size - 1)
    w = weights(held)
    return held[w != 0], w[w != 0], n[held[w != 0]]


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Dense weights (the last one is the intercept) from rows (doc_id, text) and (doc_id, toxic).

    Labels that are null or no 0/1 are left out; an id with several labels is toxic if one says so. Rows that
    repeat are learned from as often as they occur. Rows of a shard come by the hash of their id, ties by id and
    text, so the order of the table does not matter. Without any labelled row all weights are zero but the
    intercept, which then scores 0.01. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Bounded by ``sample`` rows of two numbers, hence small enough to broadcast.
    chosen = materialise(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample))
    shards = max(1, round(chosen.count() / s.shard_rows))
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialise(rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "text", "toxic"))
    size = (1 << s.bits) + 1
    model, squares = np.zeros(size, np.float32), np.zeros(size, np.float32)

    for _ in range(s.rounds):
        at = np.flatnonzero(model)
        start = spark.sparkContext.broadcast((at, model[at], squares[at]))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(s.bits, s.stem)
            shard, rows = None, []

            def done() -> pa.RecordBatch:
                begin, seen = np.zeros(size, np.float32), np.zeros(size, np.float32)
                begin[start.value[0]], seen[start.value[0]] = start.value[1:]
                held, w, n = fit_shard(rows, begin, seen, s)
                many = float(len(rows))
                return pa.RecordBatch.from_arrays(
                    [pa.array(held, pa.int64()), *(pa.array(x.astype(float)) for x in (w * many, n * many, np.full(len(held), many)))], ["feature", "w", "squares", "n"])

            for batch in batches:
                for now, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now != shard and rows:
                        yield done()
                        rows = []
                    shard = now
                    rows.append((np.unique(features(text)), mark))
            if rows:
                yield done()

        # Ranges give every shard a task of its own, where hashes of a few numbers would meet.
        dealt = sample.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(1)), "doc_id", "text")
        parts = materialise(dealt.select("shard", "text", "toxic").mapInArrow(train, "feature long, w double, squares double, n double"))
        # L1 leaves few weights; there are at most 2^bits in any case.
        kept = parts.groupBy("feature").agg(*(F.sum(x).alias(x) for x in ("w", "squares", "n"))).toArrow()
        model, squares = np.zeros(size, np.float32), np.zeros(size, np.float32)
        if kept.num_rows == 0:
            model[-1] = -4.6
            break
        at, w, n2, n = (np.asarray(kept[x]) for x in ("feature", "w", "squares", "n"))
        model[at], squares[at] = w / n.max(), n2 / n
    return model


def score(docs: DataFrame, model: np.ndarray, s: Settings = Settings(), carry: str = "") -> DataFrame:
    """doc_id, score for each row, by a broadcast of the weights that are not zero.

    Null and empty texts get the intercept's score. Texts are read whole. Repeated rows stay repeated.
    Other columns are not read; with ``carry`` all columns pass through, and the score has that name.
    """
    small_batches(docs.sparkSession)
    at = np.flatnonzero(model)
    weights = docs.sparkSession.sparkContext.broadcast((at, model[at]))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(s.bits, s.stem)
        dense = np.zeros((1 << s.bits) + 1, np.float32)
        dense[weights.value[0]] = weights.value[1]
        for batch in batches:
            z = np.full(len(batch), float(dense[-1]))
            for i, text in enumerate(batch):
                found = features(bytes(text))
                z[i] += dense[np.unique(found[dense[found] != 0])].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return docs.select(*docs.columns if carry else ["doc_id"], of(text_bytes()).alias(carry or "score"))


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, fitted on labels of rows that are not held out."""
    model = fit(docs.select("doc_id", "text"), labels.filter(~held_out("doc_id", 4, 2)), s)
    return score(docs, model, s).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
