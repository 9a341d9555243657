"""Vector code compression: product codes of integer vectors with memoised grid cells (operator 13).

Components become integers, vectors are cut into parts, and each part position has a codebook that rounds of
assignment and averaging fit to all vectors. To find a part's nearest entry, its components are divided
by the width of a grid: that is its coarse cell. For a cell, an entry is dominated if its least distance to
the cell's box is beyond another's largest; the entries that are left are kept in a table hashed by cell, and
only they are measured exactly for the parts that fall into the cell. Both distances are sums over components
of one term for each coordinate and entry, so these terms are tabled as well.

A round reads all vectors where they are, each task adds up its parts by entry, and Spark adds up the tasks'
sums; the driver sees the codebooks alone, whose size is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from obsline.llm.common import materialise, small_batches


@dataclass(frozen=True)
class Settings:
    scale: int = 1024  # integers are floor(scale * component)
    parts: int = 4
    entries: int = 256  # to a codebook, at most 256
    rounds: int = 4
    cell: int = 64  # width of a grid cell
    most_cells: int = 1 << 15  # cells of a part position that a task keeps; then it starts anew
    rows: int = 1024  # vectors that are measured at a time


class Cells:
    """Nearest entries of one codebook; ``evaluated`` counts the exact distances, ``asked`` the parts."""

    def __init__(self, book: np.ndarray, s: Settings):
        self.book, self.s = book, s
        self.memo: dict[bytes, bytes] = {}
        self.evaluated = self.asked = self.made = 0

    def _undominated(self, cells: np.ndarray) -> list[bytes]:
        """For each cell, the entries that are nearest to some place of its box."""
        near = np.zeros((len(cells), len(self.book)), np.int64)
        far = np.zeros_like(near)
        for column, entries in zip(cells.T, self.book.T, strict=True):
            places, at = np.unique(column, return_inverse=True)
            low = places[:, None] * self.s.cell
            below, above = low - entries, entries - (low + self.s.cell - 1)
            near += (np.maximum(np.maximum(below, above), 0) ** 2)[at]
            far += (np.maximum(np.abs(below), np.abs(above)) ** 2)[at]
        left = near <= far.min(axis=1)[:, None]
        return [np.flatnonzero(row).astype(np.uint8).tobytes() for row in left]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the lower one of equals, and the squared distance."""
        cells = parts // self.s.cell
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel().tolist()
        if len(self.memo) > self.s.most_cells:
            self.memo.clear()
        new = {key: i for i, key in enumerate(keys) if key not in self.memo}
        if new:
            self.memo.update(zip(new, self._undominated(cells[list(new.values())]), strict=True))
        found = [self.memo[key] for key in keys]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        entry = np.frombuffer(b"".join(found), np.uint8)
        row = np.repeat(np.arange(len(parts)), counts)
        gap = ((parts[row] - self.book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(gap, np.cumsum(counts) - counts)
        hit = np.flatnonzero(gap == least[row])
        first = hit[np.unique(row[hit], return_index=True)[1]]
        self.evaluated, self.asked, self.made = self.evaluated + len(gap), self.asked + len(parts), self.made + len(new)
        return entry[first], least


def bound(width: int) -> int:
    """Integers are held within this, so that a squared distance stays below 2 ** 62."""
    return 1 << ((62 - max(width - 1, 0).bit_length()) // 2 - 1)


def integers(vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Rows by parts by components; widths that the parts do not divide are filled up with zeros."""
    size = -(-vectors.shape[1] // s.parts)
    most = bound(size)
    whole = np.clip(np.floor(vectors * s.scale), -most, most).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, size * s.parts - whole.shape[1]))).reshape(len(whole), s.parts, size)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigned(batches: Iterator[pa.RecordBatch], column: int, width: int, books: list[np.ndarray], s: Settings) -> Iterator[tuple]:
    """Slices of the batches with their integers, codes (rows by parts) and errors."""
    cells = [Cells(book, s) for book in books]
    for batch in batches:
        for at in range(0, len(batch), s.rows):
            part = batch.slice(at, s.rows)
            whole = integers(_vectors(part.column(column), width), s)
            found = [c.nearest(whole[:, p]) for p, c in enumerate(cells)]
            yield part, whole, np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def averaged(vectors: DataFrame, width: int, books: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """The codebooks after one round; an entry without parts stays."""
    size = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((s.parts, len(books[0]), size), np.int64)
        counts = np.zeros((s.parts, len(books[0])), np.int64)
        for _, whole, codes, _ in _assigned(batches, 0, width, books, s):
            for p in range(s.parts):
                np.add.at(sums[p], codes[:, p], whole[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=len(books[0]))
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"])

    each = vectors.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    after = [book.copy() for book in books]
    for row in total.collect():  # one row an entry
        after[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    return after


def compress(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (), s: Settings = Settings()) -> tuple[list[np.ndarray], DataFrame]:
    """The codebooks, one for each part position (entries by components), and the coded rows.

    Coded rows are ``ident``, the columns of ``carry``, codes (array<int>, one index a part) and error (the parts' squared
    distances, added up). A row whose vector is null, empty, or holds a null or non-finite component is
    dropped, and so is one of another width than most (the smaller width, if there are as many of two). Codebooks start from the rows with
    the least ids (a null id after all others, equal ids by their vectors), so fewer rows than entries make shorter
    codebooks. Rows that repeat are coded each. Integers beyond ``bound`` are held there. Without rows there is no codebook and no coded row.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    plain = rows.select(F.col(ident).alias("_id"), F.struct(F.col(ident).alias(ident), *[F.col(c).alias(c) for c in carry]).alias("_told"), F.col(vector).cast("array<double>").alias("v"))
    sound = plain.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    schema = sound.select("_told").schema.add("codes", ArrayType(IntegerType())).add("error", LongType())
    widths = sound.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return [], spark.createDataFrame([], schema).select("_told.*", "codes", "error")
    width = widths["width"]
    kept = sound.filter(F.size("v") == width)
    seeds = kept.orderBy(F.col("_id").asc_nulls_last(), "v").limit(s.entries).select("v").toArrow()
    first = integers(_vectors(seeds["v"].combine_chunks(), width), s)
    books = [first[:, p].copy() for p in range(s.parts)]
    for _ in range(s.rounds):
        books = averaged(kept.select("v"), width, books, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, codes, errors in _assigned(batches, 1, width, books, s):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors)], schema.names)

    coded = kept.select("_told", "v").mapInArrow(run, schema)
    return books, coded.select("_told.*", "codes", "error")


def decode(coded: DataFrame, books: list[np.ndarray], s: Settings = Settings()) -> DataFrame:
    """Coded rows with ``vector``, the components that their codes stand for (the lower ends of the integers)."""
    tables = [F.array(*[F.array(*[F.lit(float(x) / s.scale) for x in entry]) for entry in book.tolist()]) for book in books]
    return coded.withColumn("vector", F.flatten(F.array(*[table[F.col("codes")[p]] for p, table in enumerate(tables)])))


def books_digest(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_total(coded: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over the rows of equal ``key``, nulls together.

    Keys that a thousandth of all rows share are a thousand at most and are broadcast; the others meet by a shuffle.
    """
    totals = materialise(coded.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("_n")))
    most = totals.agg(F.sum("_n")).first()[0] or 0
    rare, often = F.col("_n") * 1000 < most, F.col("_n") * 1000 >= most

    def met(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col(key).alias("_key"), F.col(name), F.lit(1).alias("_met"))
        return rows.join(some, F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")

    marked = met(coded, F.broadcast(totals.filter(often)), "left")
    hot = marked.filter("_met IS NOT NULL").drop("_met")
    rest = met(marked.filter("_met IS NULL").drop(name, "_met"), totals.filter(rare), "inner").drop("_met")
    return hot.unionByName(rest)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, coded = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), carry=("label",))
    found = with_total(materialise(coded), "label", "error", "label_error")
    return found.select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p))",
        "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM parts QUALIFY k < 256)"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, min(gap) AS gap, arg_min(k, gap * 256 + k) AS k FROM (SELECT vec_id, label, p, x, k,
  list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS gap FROM parts JOIN c{r} USING (p)) GROUP BY vec_id, label, p, x)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT p, k, list(m ORDER BY i) AS c FROM (
  SELECT p, k, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT p, k, unnest(x) AS e, unnest(range(len(x))) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k) AS n USING (p, k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error,
  (sum(sum(gap)) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM a{rounds} GROUP BY vec_id, label"""


OP13_SQL = _sql()
