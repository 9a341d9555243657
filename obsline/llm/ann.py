"""Nearest neighbours by randomly rotated one-bit codes (operator 9).

Equal vectors are folded first: a content keeps its least ids, as many as an answer can use, so that a
vector which a third of all rows share is coded, searched and answered once. Every distinct vector is
coded once, at the list of its nearest centre (fitted on a bounded sample): the residual to the centre,
rotated at random, keeps one packed bit a dimension, its length and its agreement with the code.

Vectors are dealt over shelves at random, so each shelf has its share of every list, and none is written twice. Queries
travel as packed matrices, one copy a shelf. Within a shelf a query probes the lists nearest to it. Packed codes give an
estimate of each inner product, by tables of the partial sums of a byte, with an error bound. The two nearest lists give
a first floor: the k-th best exact score. Lists whose centre and radius keep them below the floor are passed over, then
vectors whose upper bound stays below it; only the rest are measured on the original vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsline.llm.common import materialise, small_batches


@dataclass(frozen=True)
class Settings:
    k: int = 5
    sample: int = 65_536  # vectors that the centres are fitted on, at most
    sample_numbers: int = 1 << 24  # and components of them
    per_list: int = 1_000  # distinct vectors to a list, on average
    most_lists: int = 4_096  # centres are broadcast: at most this many; beyond, lists grow
    probes: float = 0.6  # share of the lists that a query probes, however many there are ...
    least_probes: int = 24  # ... but at least so many
    shelf: int = 1 << 18  # vectors that a task holds, at most; queries are copied once a shelf ...
    least_shelf: int = 2_048  # ... and shelves are as many as tasks, down to this size
    pack: int = 128  # queries to a packed matrix
    error: float = 2.5  # bounds hold within so many standard deviations
    seed: int = 5


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Every row by a power of two, so that its largest component is below one and no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def units(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def encode(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, the residuals' lengths, and <code, residual> of unit vectors."""
    rest = rest @ turn
    length = np.linalg.norm(rest, axis=1)
    agree = np.abs(rest).sum(axis=1) / np.sqrt(rest.shape[1]) / np.maximum(length, 1e-300)
    return np.packbits(rest > 0, axis=1), length, np.maximum(agree, 1e-6)


#: What rounding may take from an estimate.
SLACK = 1e-5
#: Of each byte value, its bits as signs, the first bit first.
SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).T


def byte_tables(turned: np.ndarray) -> np.ndarray:
    """(bytes, queries, 256): what each value of each code byte adds to a query's inner product with the code."""
    size = turned.shape[1]
    padded = np.pad(turned, ((0, 0), (0, -size % 8))).reshape(len(turned), -1, 8).astype(np.float32)
    return np.ascontiguousarray((padded @ SIGNS).transpose(1, 0, 2)) / np.float32(np.sqrt(size))


@dataclass
class Shelf:
    """Vectors of one task, by list: unit vectors, packed codes, lengths and agreements."""

    vectors: np.ndarray
    codes: np.ndarray
    length: np.ndarray
    agree: np.ndarray
    lists: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.lists, kind="stable")
        self.vectors, self.codes, self.length, self.agree, self.lists = (
            x[self.order] for x in (self.vectors, self.codes, self.length, self.agree, self.lists))
        self.names, self.starts = np.unique(self.lists, return_index=True)
        self.ends = np.append(self.starts[1:], len(self.lists))
        self.radius = np.maximum.reduceat(self.length, self.starts) if len(self.starts) else np.zeros(0)
        self.measured = 0  # exact scores so far

    def search(self, queries: np.ndarray, centres: np.ndarray, turn: np.ndarray, probes: int, k: int, error: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) pairs of the unit vectors that may be among the k best of their query in this shelf."""
        size = queries.shape[1]
        to_centre = queries @ centres.T
        asked = np.zeros(to_centre.shape, bool)
        near = np.argpartition(-to_centre, min(probes, len(centres)) - 1, axis=1)[:, :probes]
        np.put_along_axis(asked, near, True, axis=1)
        to_centre, asked = to_centre[:, self.names], asked[:, self.names]  # the lists that have vectors here
        tables = byte_tables(queries @ turn)
        best = np.full((len(queries), k), -np.inf)
        scale = self.length / self.agree
        # The part of a query across the code spreads with deviation sqrt((1 - agree^2) / (size - 1)).
        spread = error * scale * np.sqrt(np.maximum(1 - self.agree**2, 0) / max(size - 1, 1))
        of, at = [], []

        def look(n: int, rows: np.ndarray, first: bool) -> None:
            start, end = self.starts[n], self.ends[n]
            codes = self.codes[start:end]
            estimate = np.zeros((len(rows), end - start), np.float32)
            for table, byte in zip(tables, codes.T, strict=True):
                estimate += table[rows][:, byte]
            estimate = estimate * scale[start:end] + to_centre[rows, n][:, None]
            if first:
                few = min(k, end - start)
                hit = np.zeros(estimate.shape, bool)
                np.put_along_axis(hit, np.argpartition(-estimate, few - 1, axis=1)[:, :few], True, axis=1)
            else:
                hit = estimate + spread[start:end] + SLACK >= best[rows, -1][:, None]
            row, place = np.nonzero(hit)
            if not len(row):
                return
            exact = np.einsum("ij,ij->i", queries[rows[row]], self.vectors[start + place])
            self.measured += len(exact)
            counts = np.bincount(row, minlength=len(rows))
            scores = np.full((len(rows), k + counts.max()), -np.inf)
            if not first:
                scores[:, :k] = best[rows]
            scores[row, k + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = exact
            if first:
                firsts.append((rows, -np.sort(-scores, axis=1)[:, :k]))
            else:
                best[rows] = -np.sort(-scores, axis=1)[:, :k]
                of.append(rows[row])
                at.append(start + place)

        # A first floor from the two nearest lists: their k best estimates, measured.
        firsts: list[tuple[np.ndarray, np.ndarray]] = []
        ranked = np.argsort(-np.where(asked, to_centre, -np.inf), axis=1)[:, :2]
        for n in np.unique(ranked):
            rows = np.flatnonzero((ranked == n).any(axis=1) & asked[:, n])
            if len(rows):
                look(n, rows, True)
        floors = np.full((len(queries), 2 * k), -np.inf)
        for rows, found in firsts:
            both = np.concatenate([floors[rows], found], axis=1)
            floors[rows] = -np.sort(-both, axis=1)[:, : 2 * k]
        best[:] = floors[:, k - 1 : k]  # the floor alone: its vectors come again below
        for n in range(len(self.names)):
            rows = np.flatnonzero(asked[:, n] & (to_centre[:, n] + self.radius[n] + SLACK >= best[:, -1]))
            if len(rows):
                look(n, rows, False)
        if not of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(of), self.order[np.concatenate(at)]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; powers of two that keep squares finite change no digit."""
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


CODED = ["v", "ids", "list", "code", "length", "agree"]


def _vectors_at(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    """Rows of a list column, each once however often it is asked for."""
    few, back = np.unique(at, return_inverse=True)
    return column.take(pa.array(few)).flatten().to_numpy(zero_copy_only=False).reshape(len(few), width)[back]


def fold_equal(found: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``keep`` least ids.

    Copies are folded within a task, then by vector and a salt, then by vector, so that no group grows
    with the number of copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(v) for v in held], pa.list_(pa.float64())), pa.array(list(held.values()), pa.list_(pa.int64()))],
                ["v", "ids"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault((np.array(v, float) + 0.0).tobytes(), [])  # + 0.0: minus zero is zero
                if i not in ids:
                    ids.append(i)
                    ids.sort()
                    del ids[keep:]
            if len(held) > 20_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    part = found.mapInArrow(run, "v array<double>, ids array<long>")
    salted = part.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(64))).groupBy("v", "salt").agg(least)
    return salted.groupBy("v").agg(least)


def nearest(rows: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``rows`` to each of ``queries`` by cosine.

    Both are (vec_id, embedding); the query's own id is no candidate. Ties go to the smaller vec_id. A
    vector that is null, zero, or holds a null or non-finite component takes no part, nor does one of
    another width than most, nor one whose id is null or no 64-bit integer. Rows repeated in full
    count once as candidates and are answered as often as they ask. No rows, or no queries,
    give an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)

    def sound(df: DataFrame, name: str) -> DataFrame:
        cast = df.select(F.col("vec_id").try_cast("long").alias(name), F.col("embedding").cast("array<double>").alias("v"))
        return cast.filter(
            F.col(name).isNotNull() & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))

    found = sound(rows, "vec_id")
    folded = materialise(fold_equal(found, s.k + 1))  # one id more than k, as one may be the query's own
    widths = folded.groupBy(F.size("v").alias("width")).agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "width").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], empty)
    width = widths["width"]
    distinct = folded.filter(F.size("v") == width)
    total = distinct.count()
    lists = int(min(s.most_lists, max(1, total // s.per_list)))
    most = max(lists, min(s.sample, max(lists * 64, 1024), s.sample_numbers // width))
    sample = distinct.orderBy(F.xxhash64("v")).limit(most).select("v").toArrow()
    points = sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    centres = fit_centres(units(points), lists, s.seed)
    probes = int(min(lists, max(s.least_probes, round(lists * s.probes))))
    shared = spark.sparkContext.broadcast((centres, rotation(width, s.seed)))

    def plain(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = shared.value
        for batch in batches:
            if len(batch):
                vectors = units(plain(batch.column(0)))
                near = (vectors @ centres.T).argmax(axis=1)
                codes, length, agree = encode(vectors - centres[near], turn)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.int32()), pa.array(map(bytes, codes), pa.binary()), pa.array(length), pa.array(agree)], CODED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), s.pack):
                part = batch.slice(at, s.pack)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([plain(part.column(1)).tobytes()], pa.binary())], ["ids", "code"])

    # Equal queries are searched once, under the least of their ids.
    asked = sound(queries, "query_id").filter(F.size("v") == width)
    leaders = materialise(fold_equal(asked, 1).select(F.element_at("ids", 1).alias("q"), "v"))
    shelves = max(-(-total // s.shelf), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // s.least_shelf)))
    coded = distinct.select("v", "ids").mapInArrow(assign, "v array<double>, ids array<long>, list int, code binary, length double, agree double")
    shelved = coded.select(F.pmod(F.xxhash64("v"), F.lit(shelves)).cast("int").alias("shelf"), F.lit(0).alias("kind"), *CODED)
    packed = leaders.select("q", "v").mapInArrow(pack, "ids array<long>, code binary")
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"), F.lit(1).alias("kind"), F.lit(None).cast("array<double>").alias("v"), "ids",
                         F.lit(None).cast("int").alias("list"), "code", F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("agree"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shelf, vectors before queries; a shelf's vectors are held while its queries pass."""
        centres, turn = shared.value
        now, held, shelf, whole = None, [], None, None
        for batch in batches:
            names = np.asarray(batch.column(0))
            kinds = np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if names[start] != now:
                    now, held, shelf = names[start], [], None
                if kinds[start] == 0:
                    held.append(part)
                    continue
                if shelf is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    vectors, length, agree, lists = (whole[c].combine_chunks() for c in ("v", "length", "agree", "list"))
                    codes = np.frombuffer(b"".join(whole["code"].to_pylist()), np.uint8).reshape(len(whole), -1)
                    shelf = Shelf(units(plain(vectors)), codes, np.asarray(length), np.asarray(agree), np.asarray(lists))
                    held = []
                if shelf is None:
                    continue
                for ids, data in zip(part.column("ids").to_pylist(), part.column("code").to_pylist(), strict=True):
                    asks = np.frombuffer(data).reshape(len(ids), width)
                    of, at = shelf.search(units(asks), centres, turn, probes, s.k + 1, s.error)
                    yield from answered(np.array(ids), asks, of, at, whole)

    def answered(ids: np.ndarray, asks: np.ndarray, of: np.ndarray, at: np.ndarray, whole: pa.Table) -> Iterator[pa.RecordBatch]:
        """The k + 1 best of each query and whatever ties with them: ids decide between ties."""
        if not len(of):
            return
        rows = _vectors_at(whole["v"].combine_chunks(), at, width)
        exact = cosines(asks[of], rows)
        order = np.lexsort((-exact, of))
        of, at, exact = of[order], at[order], exact[order]
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sizes = np.diff(np.append(begins, len(of)))
        floor = exact[begins + np.minimum(sizes, s.k + 1) - 1]
        keep = exact >= np.repeat(floor, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[of[keep]]), whole["ids"].combine_chunks().take(pa.array(at[keep])), pa.array(exact[keep])], ["q", "ids", "score"])

    hits = shelved.unionByName(sent).repartitionById(shelves, "shelf").sortWithinPartitions("shelf", "kind").mapInArrow(scan, "q long, ids array<long>, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = (
        hits.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= s.k + 1)
        .groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("best"))
    )
    answers = materialise(leaders.join(best, "q").select("v", "best"))
    ranked = asked.join(answers, "v").select(
        "query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, s.k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op9_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))
