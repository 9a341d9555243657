"""Hierarchical Pitman-Yor language model (operator 5).

Restaurants: one for each context, which is the previous word itself (or the start of a text); their common
parent is the root, whose base is uniform over the types and one unknown. A dish is a word or the end.

The state of a (restaurant, dish) pair is its number of customers c and of tables t. A Gibbs step draws the whole
seating of a pair at once. Given a gamma variable v of the restaurant, v ~ Gamma(theta / d + T), the tables of
its dishes are independent of each other, P(t) ~ (v d p)^t S_d(c, t), with p the parent's probability of the
dish and S_d generalised Stirling numbers (how many seatings of c customers have t tables, by weight). So all
pairs of all restaurants are drawn side by side, and each sweep seats every customer anew.

1. Documents are taken in blocks. A block asks for its distinct pairs, with their counts in training text.
   Pairs are dealt to buckets by context, those of a context with very many tokens by context and dish. So a
   pair, however common, reaches its bucket once from each block.
2. A bucket merges what it gets. Pairs with one customer have one table for good; only the others (the bucket's
   light row) go through sweeps.
3. A sweep has two parts. Parts of the root (words dealt by hash) sum the tables of each word over the buckets
   that hold it, draw the root's tables and reply; buckets then draw theirs. Totals of restaurants are within
   a bucket; those of split contexts (at most MOST_SPLIT) are summed by Spark and broadcast.
4. After the burn-in each sweep is a sample. Predictive probabilities are averaged over samples and sent back
   to the blocks that asked, where they are summed by document.

Every draw hashes the pair and the sweep, so results do not depend on how rows, blocks or buckets are laid out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.llm.common import collect_garbage, discard, held_out, materialise, small_batches, text_bytes, write_shared

START, END = (xxhash.xxh3_64_intdigest(x) for x in (b" start", b" end"))  # no word holds a space
#: At most so many contexts are split over buckets, whatever the corpus.
MOST_SPLIT = 100_000
#: Pairs with more customers draw their tables from a limit distribution in place of Stirling numbers.
EXACT_CUSTOMERS = 128
#: Answers hold log10 probabilities in steps of 1 / SCALE.
SCALE = 1 << 16


@dataclass(frozen=True)
class Settings:
    burn_in: int = 2
    samples: int = 3
    theta: tuple[float, float] = (10.0, 1.0)  # first strengths of root and contexts; re-estimated in each sweep
    common: int = 65_536  # words that requests name by number; a matter of size alone
    block_bytes: int = 8 << 20
    bucket_tokens: int = 1_500_000
    seed: int = 11


# ---- packing of arrays

def small(a: np.ndarray) -> np.ndarray:
    """The same non-negative values in the smallest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def pack(*arrays: np.ndarray) -> bytes:
    parts = []
    squeeze = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        data = squeeze.compress(np.ascontiguousarray(a).tobytes())
        parts.append(a.dtype.str.encode().ljust(4) + len(data).to_bytes(8, "little") + data)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    loose = zstandard.ZstdDecompressor()
    while at < len(data):
        kind, size = data[at : at + 4].decode().strip(), int.from_bytes(data[at + 4 : at + 12], "little")
        out.append(np.frombuffer(loose.decompress(data[at + 12 : at + 12 + size]), kind))
        at += 12 + size
    return out


def planes(a: np.ndarray) -> np.ndarray:
    """Non-negative integers by rows of their bytes, which pack better; the first byte is their width."""
    plain = small(a)
    return np.concatenate([np.array([plain.itemsize], np.uint8), np.ascontiguousarray(plain).view(np.uint8).reshape(-1, plain.itemsize).T.ravel()])


def from_planes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a[1:].reshape(int(a[0]), -1).T).view(f"u{a[0]}").ravel().astype(np.int64)


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, ...: each number as often as its count says."""
    return np.repeat(np.arange(len(counts)), counts)


def name_words(hashes: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Words as a mask of the common ones, their numbers, and the hashes of the others."""
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    return [np.array([len(hashes)], np.uint32), np.packbits(known), small(at[known]), hashes[~known]]


def read_words(n: np.ndarray, mask: np.ndarray, numbers: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    known = np.unpackbits(mask, count=int(n[0])).astype(bool)
    out = np.empty(int(n[0]), np.uint64)
    out[known], out[~known] = common[numbers], others
    return out


# ---- draws

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on key and salt alone."""
    x = mixed(keys ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normal(keys: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(keys, 2 * salt))) * np.cos(2 * np.pi * uniform(keys, 2 * salt + 1))


def gamma(keys: np.ndarray, shape: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variables by squeezed normals; a shape below one is raised by one and scaled down."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    out, todo = np.empty(len(keys)), np.arange(len(keys))
    for turn in range(1000):
        if not len(todo):
            break
        x, u = normal(keys[todo], salt + 7919 * turn), uniform(keys[todo], salt + 7919 * turn + 104_729)
        v = np.maximum(1 + x / np.sqrt(9 * d[todo]), 1e-12) ** 3
        good = np.log(u) < 0.5 * x * x + d[todo] * (1 - v + np.log(v))
        out[todo[good]] = d[todo[good]] * v[good]
        todo = todo[~good]
    return np.where(low, out * uniform(keys, salt + 15_485_863) ** (1 / np.maximum(shape, 1e-9)), out)


@functools.lru_cache(8)
def stirling(d: float, most: int = EXACT_CUSTOMERS) -> np.ndarray:
    """log S_d(c, t): S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = out[c] + np.log(np.maximum(c - t * d, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables of pairs with c customers each, from P(t) ~ a^t S_d(c, t).

    Up to EXACT_CUSTOMERS by the distribution itself. Beyond, tables are points of a Poisson process whose
    sizes sum to c: with x (1 - x)^(d - 1) = c / a, their number is 1 + Poisson or normal around
    a (1 - (1 - x)^d) / d.
    """
    t = np.ones(len(c), np.int64)
    u = uniform(keys, 3 * salt)
    log_s, log_a = stirling(d), np.log(np.maximum(a, 1e-300))
    order = np.argsort(c, kind="stable")
    cuts = np.searchsorted(c[order], np.arange(2, EXACT_CUSTOMERS + 2))
    for n in range(2, EXACT_CUSTOMERS + 1):
        for at in range(cuts[n - 2], cuts[n - 1], 100_000):
            rows = order[at : min(at + 100_000, cuts[n - 1])]
            weight = log_a[rows, None] * np.arange(1, n + 1) + log_s[n, 1 : n + 1]
            total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (total < u[rows, None] * total[:, -1:]).sum(axis=1)
    rows = order[cuts[-1] :]
    if len(rows):
        t[rows] = _many_customers(c[rows].astype(float), a[rows], d, keys[rows], u[rows], salt)
    return np.minimum(np.maximum(t, 1), c)


def _many_customers(c: np.ndarray, a: np.ndarray, d: float, keys: np.ndarray, u: np.ndarray, salt: int) -> np.ndarray:
    low, high = np.zeros(len(c)), np.full(len(c), 60.0)  # of -log(1 - x)
    for _ in range(60):
        mid = (low + high) / 2
        over = -np.expm1(-mid) * np.exp(mid * (1 - d)) > c / a
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    y = (low + high) / 2
    mean = a * -np.expm1(-y * d) / d
    x, rest = -np.expm1(-y), np.exp(-y)
    spread = a * (x * rest ** (d - 1) + (1 - d) * x * x * np.exp(np.minimum(y * (2 - d), 700)))  # variance of the sum of sizes
    variance = np.maximum(mean - c * c / spread, 0)
    out = np.rint(mean + np.sqrt(variance) * normal(keys, 3 * salt + 1))
    few = mean < 40
    if few.any():
        m, goal = mean[few], u[few]
        term = np.exp(-m)
        total, found = term.copy(), np.zeros(len(m))
        for k in range(1, 200):
            found += total < goal
            term = term * m / k
            total += term
        out[few] = 1 + found
    return out.astype(np.int64)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for i in range(6):
        out -= 1 / (x + i)
    y = x + 6
    return out + np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)


def strength_stats(theta: float, d: float, customers: np.ndarray, tables: np.ndarray, times: np.ndarray | int = 1) -> list[float]:
    """Sums over restaurants whose quotient is the next theta (an EM step over the usual auxiliary variables)."""
    if not len(customers):
        return [0.0, 0.0]
    up = (theta / d) * (digamma(theta / d + tables) - digamma(theta / d + 1))
    return [float((times * np.where(tables > 1, up, 0)).sum()), float((times * np.where(customers > 1, digamma(theta + customers) - digamma(theta + 1), 0)).sum())]


# ---- first pass: common words and contexts with very many tokens

def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number of each word, and the count of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string()) if pa.types.is_binary(texts.type) else texts))
    first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
    values = lists.values.slice(first, last - first)
    held = np.asarray(pc.not_equal(pc.binary_length(values), 0))  # white space at an end leaves an empty word
    counts = np.diff(np.concatenate([[0], np.cumsum(held)])[lists.offsets.to_numpy().astype(np.int64) - first])
    coded = (values if held.all() else values.filter(pa.array(held))).dictionary_encode()
    return coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False), coded.indices.to_numpy(), counts


def hashed(words: np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def block_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches gathered until their texts (the last column) reach ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            stop = min(len(batch), int(np.searchsorted(ends, before + max(most - size, 0), "right")) + 1)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - before)
            at = stop
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def common_words(docs: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of common words, ascending, their counts, and the number of training tokens. ``docs``: (train, text).

    The start of texts counts as a word, as it is a context of its own. The counts leave out words that are rare in a
    block. They decide how data are dealt and named, not results.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in block_slices(batches, s.block_bytes):
            names, word, counts = split_words(rows["text"].combine_chunks())
            n = np.bincount(word, minlength=len(names))
            often = n * 250_000 >= len(word)
            train = np.asarray(rows["train"].combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *hashed(names[often]).view(np.int64).tolist(), START - (START >> 63 << 64)], pa.int64()),
                 pa.array([int((counts[train] + 1).sum()), *n[often].tolist(), len(train)], pa.int64())], ["word", "n"])

    counts = materialise(docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.filter("word IS NULL").select("n").first()
    found = counts.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(s.common).toArrow()  # at most ``common`` rows
    names = np.asarray(found["word"]).astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.asarray(found["n"]).astype(np.int64)[order], total["n"] if total else 0


# ---- blocks: what documents ask for

@dataclass(frozen=True)
class Layout:
    """How pairs are dealt: by context, those of split contexts by dish too; and words over parts of the root."""

    buckets: int
    parts: int
    common: np.ndarray
    split: np.ndarray  # hashes of split contexts, ascending
    pieces: np.ndarray  # and over how many buckets

    def bucket(self, context: np.ndarray, dish: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.split, context), max(len(self.split) - 1, 0))
        pieces = np.where(self.split[at] == context, self.pieces[at], 1) if len(self.split) else np.ones(len(context), np.int64)
        return ((context >> np.uint64(24)) % np.uint64(self.buckets) + (dish >> np.uint64(30)) % pieces.astype(np.uint64)).astype(np.int64) % self.buckets

    def part(self, dish: np.ndarray) -> np.ndarray:
        return ((dish >> np.uint64(16)) % np.uint64(self.parts)).astype(np.int64)

    def order(self, dishes: np.ndarray) -> np.ndarray:
        """The order of dishes by part, then hash."""
        return np.lexsort((dishes, self.part(dishes)))


def lay_out(common: np.ndarray, counts: np.ndarray, tokens: int, s: Settings) -> Layout:
    buckets = max(8, math.ceil(tokens / s.bucket_tokens))
    limit = max(s.bucket_tokens / 2, tokens / MOST_SPLIT)
    split = counts > limit
    pieces = np.minimum(np.ceil(counts[split] / limit), buckets).astype(np.int64)
    return Layout(buckets, max(4, math.ceil(buckets / 8)), common, common[split], pieces)


def block_rows(texts: pa.Array, train: np.ndarray, plan: Layout) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The block's own blob (tokens of each document, pair of each token), and a request for each bucket."""
    names, word, counts = split_words(texts)
    found = hashed(names)
    words = np.unique(np.concatenate([found, np.array([START, END], np.uint64)]))
    words = words[plan.order(words)]
    ascending = np.argsort(words)
    number = ascending[np.searchsorted(words, np.concatenate([found, np.array([START, END], np.uint64)]), sorter=ascending)]
    word = np.insert(number[word], np.cumsum(counts), number[-1])
    lengths = counts + 1
    context = np.roll(word, 1)
    context[np.cumsum(lengths) - lengths] = number[-2]
    bucket = plan.bucket(words[context], words[word])
    bits = len(words).bit_length()
    if 2 * bits + plan.buckets.bit_length() < 64:
        order = np.argsort(bucket << (2 * bits) | context << bits | word)
    else:
        order = np.lexsort((word, context, bucket))
    bucket, context, dish = bucket[order], context[order], word[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1]) | (dish[1:] != dish[:-1])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(fresh) - 1
    customers = np.bincount(pair, np.repeat(train, lengths)).astype(np.int64)
    bucket, context, dish = bucket[fresh], context[fresh], dish[fresh]
    cuts = np.searchsorted(bucket, np.arange(plan.buckets + 1))
    requests = []
    for b in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[b], cuts[b + 1])
        own, per = np.unique(context[at], return_counts=True)
        eaten, index = np.unique(dish[at], return_inverse=True)
        requests.append((int(b), pack(*name_words(words[own], plan.common), *name_words(words[eaten], plan.common), small(per), small(index), small(customers[at]))))
    return pack(small(lengths), planes(pair)), requests


def blocks(docs: DataFrame, plan: Layout, s: Settings) -> DataFrame:
    """Rows (key, block, ids and folds of documents, blob): requests by bucket; keys below zero are the blocks' own rows."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # at most ``common`` words and MOST_SPLIT contexts
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, fields = TaskContext.get().partitionId() << 24, ["key", "block", "doc_ids", "held", "data"]
        for rows in block_slices(batches, s.block_bytes):
            ids, held = rows["doc_id"].combine_chunks(), rows["held"].combine_chunks()
            blob, requests = block_rows(rows["text"].combine_chunks(), ~np.asarray(held), shared.value)
            one = pa.array([0, len(ids)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - block]), pa.array([block]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, held), pa.array([blob], pa.binary())], fields)
            for at in range(0, len(requests), 16):
                part = requests[at : at + 16]
                none = [pa.nulls(len(part), pa.list_(t)) for t in (ids.type, held.type)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in part]), pa.array([block] * len(part)), *none, pa.array([r for _, r in part], pa.binary())], fields)
            block += 1

    return docs.select("doc_id", "held", "text").mapInArrow(run, f"key long, block long, doc_ids array<{kind}>, held array<boolean>, data binary")


# ---- buckets and the root's parts

#: stats: [words seen, their tokens] or [customers, tables, pairs with one, with two customers, two sums for theta].
ROW = "kind string, bucket int, part int, block long, data binary, stats array<double>"
ROW_NAMES = ["kind", "bucket", "part", "block", "data", "stats"]
_ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.float64()))])


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows (kind, bucket, part, block, data, stats) as a table."""
    return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW) if rows else _ROW.empty_table()


@dataclass
class Light:
    """A bucket's pairs with two customers or more, by context, then dish."""

    context: np.ndarray  # of each pair, among ``contexts``, which hold all split ones too
    dish: np.ndarray  # among ``dishes``
    customers: np.ndarray
    contexts: np.ndarray  # hashes
    of_context: np.ndarray  # all customers of each context here
    single: np.ndarray  # and its pairs with one customer
    dishes: np.ndarray  # hashes, by part
    cuts: np.ndarray  # of dishes by part
    plain: np.ndarray  # contexts without such pairs: how many have 0, 1, 2, ... customers
    tables: np.ndarray
    samples: list  # tables of each sample

    def dump(self) -> bytes:
        return pack(small(np.diff(self.context, prepend=0)), small(self.dish), small(self.customers), self.contexts, small(self.of_context), small(self.single), self.dishes, small(self.cuts),
                    small(self.plain), *map(small, [self.tables, *self.samples]))

    @staticmethod
    def load(data: bytes) -> Light:
        gaps, dish, customers, contexts, of, single, dishes, cuts, plain, tables, *samples = unpack(data)
        return Light(np.cumsum(gaps, dtype=np.int64), *(x.astype(np.int64) for x in (dish, customers)), contexts, *(x.astype(np.int64) for x in (of, single)), dishes,
                     *(x.astype(np.int64) for x in (cuts, plain, tables)), [x.astype(np.int64) for x in samples])


def seat(requests: DataFrame, plan: Layout) -> DataFrame:
    """From requests: heavy rows b, light rows l, and what each bucket has of each part of the root, rows q.

    Rows t have the totals of split contexts, by their hash in ``block``; the blocks' own rows become rows h.
    """
    shared = requests.sparkSession.sparkContext.broadcast(plan)
    kind = requests.schema["doc_ids"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        documents = [rows["doc_ids"], rows["held"]]
        if rows["key"][0].as_py() < 0:
            found = _rows([("h", -1, None, b.as_py(), d.as_py(), None) for b, d in zip(rows["block"], rows["data"], strict=True)])
        else:
            found = merge(rows)
            documents = [pa.nulls(len(found), c.type) for c in documents]
        for name, column in zip(("doc_ids", "held"), documents, strict=True):
            found = found.append_column(name, column)
        return found

    def merge(rows: pa.Table) -> pa.Table:
        plan, bucket = shared.value, rows["key"][0].as_py()
        names = rows["block"].to_numpy()
        asked = []
        for d in rows["data"]:
            a = unpack(d.as_py())
            asked.append((read_words(*a[:4], plan.common), read_words(*a[4:8], plan.common), *(x.astype(np.int64) for x in a[8:])))
        # Words stand in the order of parts and hashes, as in requests, so that what a block asks for is ascending.
        contexts, dishes = (np.unique(np.concatenate([a[i] for a in asked])) for i in (0, 1))
        orders = [plan.order(x) for x in (contexts, dishes)]
        places = [np.empty(len(x), np.int64) for x in orders]
        for place, order in zip(places, orders, strict=True):
            place[order] = np.arange(len(order))
        keys = [np.repeat(places[0][np.searchsorted(contexts, c)], per) << 32 | places[1][np.searchsorted(dishes, d)][index] for c, d, per, index, _ in asked]
        contexts, dishes = contexts[orders[0]], dishes[orders[1]]
        merged = np.unique(np.concatenate(keys))
        ats = [np.searchsorted(merged, k) for k in keys]
        c = np.bincount(np.concatenate(ats), np.concatenate([a[4] for a in asked]), len(merged)).astype(np.int64)
        context, dish = merged >> 32, merged & 0xFFFFFFFF
        cuts = np.searchsorted(plan.part(dishes), np.arange(plan.parts + 1))
        heavy = pack(small(np.bincount(context, minlength=len(contexts))), small(dish), small(c), small(cuts), contexts[np.isin(contexts, plan.split)],
                     small(np.flatnonzero(np.isin(contexts, plan.split))), names, np.array([len(a) for a in ats]), small(np.concatenate([np.diff(a, prepend=0) for a in ats])))
        of_context = np.bincount(context, c, len(contexts)).astype(np.int64)
        single = np.bincount(context[c == 1], minlength=len(contexts))
        seen = np.bincount(dish, c, len(dishes)).astype(np.int64)
        alone = np.bincount(dish[c == 1], minlength=len(dishes))
        several = np.flatnonzero(c > 1)
        own = np.unique(np.concatenate([context[several], np.flatnonzero(np.isin(contexts, plan.split))]))
        context_at = np.searchsorted(own, context[several])
        eaten, dish_at = np.unique(dish[several], return_inverse=True)
        plain = np.ones(len(contexts), bool)
        plain[own] = False
        plain &= ~np.isin(contexts, plan.split)
        light = Light(context_at, dish_at, c[several], contexts[own], of_context[own], single[own], dishes[eaten], np.searchsorted(eaten, cuts), np.bincount(single[plain]), np.ones(len(several), np.int64), [])
        out = [("b", bucket, -1, None, heavy, None), ("l", bucket, -1, None, light.dump(), bucket_stats(light, plan, Totals.first()))]
        tables = np.bincount(dish_at, minlength=len(eaten))
        for p in range(plan.parts):
            a, b, x, y = cuts[p], cuts[p + 1], light.cuts[p], light.cuts[p + 1]
            if b > a:
                out.append(("q", bucket, p, None, pack(*name_words(dishes[a:b], plan.common), small(seen[a:b]), small(alone[a:b]), small(eaten[x:y] - a), small(tables[x:y])), None))
        out += split_rows(contexts, of_context, np.bincount(context[c > 0], minlength=len(contexts)), plan)
        return _rows(out)

    return requests.groupBy("key").applyInArrow(run, f"{ROW}, doc_ids {kind}, held array<boolean>")


def split_rows(contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray, plan: Layout) -> list[tuple]:
    """What a bucket has of split contexts."""
    return [("t", None, None, int(contexts[i].view(np.int64)), None, [float(customers[i]), float(tables[i])]) for i in np.flatnonzero(np.isin(contexts, plan.split))]


@dataclass(frozen=True)
class Totals:
    """Numbers that all share: types and tokens, and by level (root, contexts) theta, d; the root's totals and gamma variable."""

    types: int
    tokens: int
    theta: tuple[float, float]
    d: tuple[float, float]
    customers: int
    tables: int
    v: float
    split: tuple  # hashes, customers and tables of split contexts

    @staticmethod
    def first() -> Totals:
        return Totals(0, 0, (10.0, 1.0), (0.5, 0.5), 0, 0, 0.0, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def root(self, own: np.ndarray) -> np.ndarray:
        """The root's predictive probability of dishes with ``own`` = customers - d tables."""
        return (own + (self.theta[0] + self.d[0] * self.tables) / (self.types + 1)) / (self.theta[0] + self.customers)

    def whole(self, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of contexts, those of split ones from all buckets."""
        if not len(self.split[0]):
            return customers, tables
        at = np.minimum(np.searchsorted(self.split[0], contexts), len(self.split[0]) - 1)
        hit = self.split[0][at] == contexts
        return np.where(hit, self.split[1][at], customers), np.where(hit, self.split[2][at], tables)


def bucket_stats(b: Light, plan: Layout, t: Totals) -> list[float]:
    """Customers, tables, pairs with one and two customers, and the sums for theta, of a bucket's contexts."""
    tables = b.single + np.bincount(b.context, b.tables, len(b.contexts)).astype(np.int64)
    whole = ~np.isin(b.contexts, plan.split)
    sums = strength_stats(t.theta[1], t.d[1], b.of_context[whole], tables[whole])
    k = np.flatnonzero(b.plain)
    more = strength_stats(t.theta[1], t.d[1], k, k, b.plain[k])
    one = b.single.sum() + (np.arange(len(b.plain)) * b.plain).sum()
    return [float(b.of_context.sum()), float(tables.sum()), float(one), float((b.customers == 2).sum()), sums[0] + more[0], sums[1] + more[1]]


def root_rows(part: int, keys: np.ndarray, alone: np.ndarray, customers: np.ndarray, tables: np.ndarray, at: np.ndarray, sizes: np.ndarray, names: np.ndarray, samples: list) -> bytes:
    return pack(keys, small(alone), small(customers), small(tables), small(np.concatenate([np.diff(x, prepend=0) for x in np.split(at, np.cumsum(sizes)[:-1])]) if len(at) else at), sizes, names, *samples)


def open_root(asks: DataFrame, plan: Layout) -> DataFrame:
    """From rows q: heavy rows R (every word of a part) and light rows r (words with several customers, or that may get them)."""
    shared = asks.sparkSession.sparkContext.broadcast(plan)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        part, names = rows["part"][0].as_py(), rows["bucket"].to_numpy().astype(np.int64)
        parts = [unpack(d.as_py()) for d in rows["data"]]
        words = [read_words(*p[:4], shared.value.common) for p in parts]
        keys = np.unique(np.concatenate(words))
        at = [np.searchsorted(keys, w) for w in words]
        every = np.concatenate(at)
        seen, alone = (np.bincount(every, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (4, 5))
        several = [a[p[6].astype(np.int64)] for a, p in zip(at, parts, strict=True)]
        changing = np.concatenate(several)
        customers = alone + np.bincount(changing, np.concatenate([p[7] for p in parts]), len(keys)).astype(np.int64)
        live = customers > 1
        live[changing] = True
        index = np.cumsum(live) - 1
        sizes = np.array([len(a) for a in at], np.int64)
        heavy = pack(small(seen), np.packbits(live), small(np.concatenate([np.diff(a, prepend=0) for a in at])), sizes, names)
        light = root_rows(part, keys[live], alone[live], customers[live], np.ones(int(live.sum()), np.int64), index[changing], np.array([len(x) for x in several], np.int64), names, [])
        rest = int(((customers == 1) & ~live).sum())
        stats = [float(customers.sum()), float((customers > 0).sum()), float((customers == 1).sum()), float((customers == 2).sum()), float((seen > 0).sum()), float(seen.sum()), float(rest)]
        return _rows([("R", None, part, None, heavy, stats), ("r", None, part, None, light, stats)])

    return asks.select("bucket", "part", "data").groupBy("part").applyInArrow(run, ROW)


def draw_root(state: DataFrame, t: Totals, number: int, s: Settings) -> DataFrame:
    """From rows r and values v of the buckets: the next rows r, and replies p to the buckets: customers - d tables of their words."""
    shared = state.sparkSession.sparkContext.broadcast(t)

    def run(rows: pa.Table) -> pa.Table:
        t = shared.value
        kinds = rows["kind"].to_pylist()
        own = kinds.index("r")
        keys, alone, customers, tables, gaps, sizes, names, *samples = unpack(rows["data"][own].as_py())
        part, rest = rows["part"][own].as_py(), rows["stats"][own].as_py()[6]
        ends = np.cumsum(sizes)
        at = np.concatenate([np.cumsum(g, dtype=np.int64) for g in np.split(gaps, ends[:-1])]) if len(gaps) else gaps.astype(np.int64)
        sent = {rows["bucket"][i].as_py(): unpack(rows["data"][i].as_py())[0] for i, k in enumerate(kinds) if k == "v"}
        customers = customers.astype(np.int64)
        if sent:
            values = np.concatenate([sent[int(n)] for n, size in zip(names, sizes, strict=True) if size]) if len(at) else np.zeros(0)
            customers = alone.astype(np.int64) + np.bincount(at, values, len(keys)).astype(np.int64)
        a = np.full(len(keys), t.v * t.d[0] / (t.types + 1))
        tables = np.where(customers > 0, draw_tables(np.maximum(customers, 1), a, t.d[0], keys, (s.seed * 1000 + number) * 2), 0)
        value = customers - t.d[0] * tables
        if number >= s.burn_in:
            samples = [*samples, small(customers), small(tables)]
        stats = [float(customers.sum() + rest), float(tables.sum() + rest), float((customers == 1).sum() + rest), float((customers == 2).sum()), 0.0, 0.0, rest]
        out = [("r", None, part, None, root_rows(part, keys, alone, customers, tables, at, sizes, names, samples), stats)]
        out += [("p", int(n), part, None, pack(x), None) for n, x in zip(names, np.split(value[at], ends[:-1]), strict=True) if len(x)]
        return _rows(out)

    return state.groupBy("part").applyInArrow(run, ROW)


def draw_buckets(state: DataFrame, t: Totals, plan: Layout, number: int, s: Settings) -> DataFrame:
    """From rows l and the root's replies p: the next rows l, values v for the root, and totals t of split contexts."""
    shared = state.sparkSession.sparkContext.broadcast((t, plan))

    def run(rows: pa.Table) -> pa.Table:
        t, plan = shared.value
        rows = rows.sort_by("part")  # the bucket's own row has part -1
        b, bucket = Light.load(rows["data"][0].as_py()), rows["bucket"][0].as_py()
        value = np.concatenate([np.zeros(0), *(unpack(d.as_py())[0] for d in rows["data"][1:])])
        if number >= s.burn_in:
            b.samples.append(b.tables)
        if number < s.burn_in + s.samples - 1:
            tables = b.single + np.bincount(b.context, b.tables, len(b.contexts)).astype(np.int64)
            _, whole = t.whole(b.contexts, b.of_context, tables)
            v = gamma(b.contexts, t.theta[1] / t.d[1] + whole, (s.seed * 1000 + number) * 7)
            a = v[b.context] * t.d[1] * t.root(value)[b.dish]
            keys = mixed(b.contexts)[b.context] ^ b.dishes[b.dish]
            b.tables = draw_tables(b.customers, a, t.d[1], keys, (s.seed * 1000 + number) * 2 + 1)
        sums = np.bincount(b.dish, b.tables, len(b.dishes)).astype(np.int64)
        out = [("l", bucket, -1, None, b.dump(), bucket_stats(b, plan, t))]
        out += [("v", bucket, p, None, pack(small(sums[b.cuts[p] : b.cuts[p + 1]])), None) for p in range(plan.parts) if b.cuts[p + 1] > b.cuts[p]]
        out += split_rows(b.contexts, b.of_context, b.single + np.bincount(b.context, b.tables, len(b.contexts)).astype(np.int64), plan)
        return _rows(out)

    return state.groupBy("bucket").applyInArrow(run, ROW)


def last_replies(state: DataFrame) -> DataFrame:
    """From rows R and r: replies p to the buckets with counts of all their words, and the root's customers and tables in each sample."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_pylist()
        seen, live, gaps, sizes, names = unpack(rows["data"][kinds.index("R")].as_py())
        live = np.unpackbits(live, count=len(seen)).astype(bool)
        own = [seen.astype(np.int64)]
        for x in unpack(rows["data"][kinds.index("r")].as_py())[7:]:
            value = (seen > 0).astype(np.int64)  # one customer and table, if any
            value[live] = x
            own.append(value)
        ends = np.cumsum(sizes)
        part, out = rows["part"][0].as_py(), []
        for n, g in zip(names, np.split(gaps, ends[:-1]), strict=True):
            at = np.cumsum(g, dtype=np.int64)
            out.append(("p", int(n), part, None, pack(*(planes(x[at]) for x in own)), None))
        return _rows(out)

    return state.groupBy("part").applyInArrow(run, ROW)


def answers(state: DataFrame, samples: list[Totals]) -> DataFrame:
    """From rows b, l and replies p: for each block log10 of the averaged probability in steps of 1 / SCALE, and the count of the dish, pair by pair as asked."""
    shared = state.sparkSession.sparkContext.broadcast(samples)

    def run(rows: pa.Table) -> pa.Table:
        kinds, bucket = rows["kind"].to_pylist(), rows["bucket"][0].as_py()
        per, dish, c, _, split, split_at, names, sizes, gaps = unpack(rows["data"][kinds.index("b")].as_py())
        b = Light.load(rows["data"][kinds.index("l")].as_py())
        replies = [list(map(from_planes, unpack(d.as_py()))) for d in rows.filter(pc.equal(rows["kind"], "p")).sort_by("part")["data"]]
        seen, *drawn = (np.concatenate(x) for x in zip(*replies, strict=True))
        c, context = c.astype(np.int64), spans(per)
        # Split contexts have totals of their own hash; others never look it up.
        hashes = np.zeros(len(per), np.uint64)
        hashes[split_at] = split
        of_context = np.bincount(context, c, len(per)).astype(np.int64)
        total = np.zeros(len(c))
        for i, t in enumerate(shared.value):
            tables = (c > 0).astype(np.int64)
            tables[c > 1] = b.samples[i]
            customers, held = t.whole(hashes, of_context, np.bincount(context, tables, len(per)).astype(np.int64))
            root = t.root(drawn[2 * i] - t.d[0] * drawn[2 * i + 1])
            below, share = t.theta[1] + t.d[1] * held, t.theta[1] + customers
            total += (c - t.d[1] * tables + below[context] * root[dish]) / share[context]
        score = np.rint(-SCALE * np.log10(total / len(shared.value))).astype(np.int64)
        out, ends = [], np.cumsum(sizes)
        for name, g in zip(names, np.split(gaps, ends[:-1]), strict=True):
            at = np.cumsum(g, dtype=np.int64)
            out.append((int(name), bucket, pack(planes(score[at]), planes(seen[dish[at]]))))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary())})

    return state.groupBy("bucket").applyInArrow(run, "block long, bucket int, data binary")


# ---- the model

def _sums(state: DataFrame, kind: str, n: int) -> list[float]:
    row = state.filter(F.col("kind") == kind).agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(n))).first()
    return list(row)


def _discount(one: float, two: float) -> float:
    return float(min(0.95, max(0.05, one / (one + 2 * two)))) if one + two else 0.5


def _strength(sums: list[float], before: float) -> float:
    """Rounded, so that the order of sums does not matter."""
    return float(f"{min(1e4, max(1e-2, sums[0] / sums[1])):.6g}") if sums[0] > 0 and sums[1] > 0 else before


def _split_totals(state: DataFrame) -> tuple:
    """Hashes, customers and tables of split contexts: at most MOST_SPLIT rows."""
    found = state.filter("kind = 't'").groupBy("block").agg(F.sum(F.col("stats")[0]).alias("c"), F.sum(F.col("stats")[1]).alias("t")).toArrow()
    names, c, t = np.asarray(found["block"]).astype(np.int64).view(np.uint64), np.asarray(found["c"]).astype(np.int64), np.asarray(found["t"]).astype(np.int64)
    order = np.argsort(names)
    return names[order], c[order], t[order]


def gibbs(requests: DataFrame, plan: Layout, s: Settings) -> tuple[DataFrame, DataFrame, Totals]:
    """The blocks' own rows, (block, bucket, blob) answers to requests, and the last totals."""
    spark = requests.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = write_shared(df)
        return spark.read.schema(ROW).parquet(path), path

    seats = seat(requests, plan)
    first_path = write_shared(seats, "kind")
    first = spark.read.schema(seats.schema).parquet(first_path)
    own, heavy, light, light_path = first.filter("kind = 'h'"), first.filter("kind = 'b'").select(*ROW_NAMES), first.filter("kind = 'l'").select(*ROW_NAMES), ""
    del seats, requests
    collect_garbage(spark)
    opened, opened_path = write(open_root(first.filter("kind = 'q'"), plan))
    discard(spark, f"{first_path}/kind=q")
    roots, root_path, values = opened.filter("kind = 'r'"), "", None
    split = _split_totals(first) if len(plan.split) else Totals.first().split
    start, one = _sums(opened, "R", 6), _sums(light, "l", 6)
    d, theta = (_discount(*start[2:4]), _discount(*one[2:4])), s.theta
    totals = Totals(int(start[4]), int(start[5]), theta, d, int(start[0]), int(start[1]), 0.0, split)
    samples = []
    for number in range(s.burn_in + s.samples):
        v = gamma(np.array([END], np.uint64), np.array([theta[0] / d[0] + totals.tables]), (s.seed * 1000 + number) * 5)[0]
        totals = replace(totals, theta=theta, d=d, v=float(v), split=split)
        older, (drawn, root_path) = root_path, write(draw_root(roots if values is None else roots.unionByName(values), totals, number, s))
        roots = drawn.filter("kind = 'r'")
        found = _sums(roots, "r", 4)
        totals = replace(totals, customers=int(found[0]), tables=int(found[1]))
        if number >= s.burn_in:
            samples.append(totals)
        older_light, (seated, light_path) = light_path, write(draw_buckets(light.unionByName(drawn.filter("kind = 'p'")), totals, plan, number, s))
        light, values = seated.filter("kind = 'l'"), seated.filter("kind = 'v'")
        for path in (older, older_light):
            if path:
                discard(spark, path)
        collect_garbage(spark)
        if len(plan.split):
            split = _split_totals(seated)
        strengths = _sums(light, "l", 6)[4:]
        if len(split[0]):
            more = strength_stats(theta[1], d[1], split[1], split[2])
            strengths = [strengths[0] + more[0], strengths[1] + more[1]]
        root = strength_stats(theta[0], d[0], np.array([totals.customers]), np.array([totals.tables]))
        theta = (_strength(root, theta[0]), _strength(strengths, theta[1]))
        d = (_discount(*found[2:4]), d[1])
    replies, replies_path = write(last_replies(opened.filter("kind = 'R'").unionByName(roots)))
    found = answers(heavy.unionByName(light).unionByName(replies), samples)
    del opened, roots, values, drawn, seated
    for path in (opened_path, root_path):
        discard(spark, path)
    collect_garbage(spark)
    answered = materialise(found)
    del found, heavy, light, replies
    for path in (f"{first_path}/kind=b", f"{first_path}/kind=l", light_path, replies_path):
        discard(spark, path)
    collect_garbage(spark)
    return own, answered, totals


def language_model(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Training rows are those that are not held out. Null text counts as empty: one token, its end.
    Repeated rows count as often as they occur. Without training text every word is unknown. An empty
    table gives an empty result. Other columns are not read; doc_id may have any type. Words are told
    apart by 64-bit hashes, and a token's log10 probability is rounded to 1 / SCALE.
    """
    small_batches(docs.sparkSession)
    plain = docs.select("doc_id", held_out("doc_id", 7, 2).alias("held"), text_bytes().alias("text"))
    common, counts, tokens = common_words(plain.select((~F.col("held")).alias("train"), "text"), s)
    plan = lay_out(common, counts, tokens, s)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own, replies, totals = gibbs(blocks(plain, plan, s), plan, s)
    kinds = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    norm, train_tokens = math.log10(totals.tokens + totals.types + 1), totals.tokens

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")  # the block's own row has bucket -1
        lengths, pair = unpack(rows["data"][0].as_py())
        lengths, pair = lengths.astype(np.int64), from_planes(pair)
        score, known = (np.concatenate(x)[pair] for x in zip(*(map(from_planes, unpack(d.as_py())) for d in rows["data"][1:]), strict=True))
        begins = np.cumsum(lengths) - lengths
        return pa.table([rows["doc_ids"][0].values, rows["held"][0].values, pa.array(lengths), pa.array(np.add.reduceat((known > 0).astype(np.int64), begins)),
                         pa.array(np.full(len(lengths), train_tokens, np.int64)),
                         pa.array(np.add.reduceat(np.log10(known + 1.0) - norm, begins)), pa.array(np.add.reduceat(score, begins) / -float(SCALE))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = replies.select("block", "bucket", F.lit(None).cast(f"array<{kind}>").alias("doc_ids"), F.lit(None).cast("array<boolean>").alias("held"), "data")
    return own.select("block", "bucket", "doc_ids", "held", "data").unionByName(asked).groupBy("block").applyInArrow(total, kinds)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
