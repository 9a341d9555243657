"""Best-fit packing by patterns fitted with non-negative least squares (operator 10).

1. Every document becomes token pieces of at most ``capacity``; each task numbers its pieces within
   their length, so that a prefix sum over tasks gives a global rank without any sort of the pieces.
2. The histogram of lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver, which
   enumerates patterns of few lengths that fill a sequence, fits repeat counts by NNLS, rounds, and packs
   what is left by best fit into the room that remains. All of it works on (length, count) runs.
3. The plan is a bounded table of runs: pieces of length L with ranks [start, start + count) go to
   sequences base, base + 1, ... at one offset. Tasks look their pieces up by binary search.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsline.llm.bpe import TEXT_BYTES, ChunkEncoder, EncodeChunks, PieceEncoder, as_strings
from obsline.llm.common import byte_slices, materialise, small_batches, text_bytes

CAPACITY = 2048
#: How many lengths the first document of a three-document pattern may have.
STEPS = 64


def nnls(rows: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares min |Ax - b|, x >= 0, by accelerated projected gradients.

    ``rows[j]`` names the rows where column j of A has a one (twice for a two, -1 for none). Rows are
    weighted by 1 / sqrt(b), so that a rare length counts by its relative misfit.
    """
    weight = np.append(1 / np.sqrt(np.maximum(b, 1.0)), 0.0)
    b = np.append(b, 0.0)
    size = len(b)

    def apply(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(rows[:, i], x, size) for i in range(rows.shape[1]))

    def transpose(y: np.ndarray) -> np.ndarray:
        return (weight * y)[rows].sum(axis=1)

    rows = np.where(rows < 0, size - 1, rows)
    probe = np.ones(len(rows))
    for _ in range(30):
        probe = transpose(apply(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = ahead = np.zeros(len(rows))
    pace = 1.0
    for _ in range(rounds):
        last, x = x, np.maximum(0, ahead - transpose(apply(ahead) - weight * b) / (1.05 * norm))
        pace, before = (1 + np.sqrt(1 + 4 * pace * pace)) / 2, pace
        ahead = x + (before - 1) / pace * (x - last)
    return x


def length_patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Patterns of one to three lengths that fill a sequence exactly, -1 for no document.

    Of those with three, the first length is one of at most STEPS evenly spaced ones; this keeps the
    table at some STEPS * capacity rows. Only lengths that are present take part.
    """
    half = np.arange(1, capacity // 2 + 1)
    two = np.stack([half, capacity - half, np.full(len(half), -1)], 1)
    found = [np.array([[capacity, -1, -1]]), two]
    step = max(1, capacity // STEPS)
    for a in range(step, capacity - 1, step):
        b = np.arange(1, (capacity - a) // 2 + 1)
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    patterns = np.concatenate(found)
    return patterns[(present[patterns] | (patterns < 0)).all(axis=1)]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece.

    The work depends on ``capacity`` alone, not on how many pieces there are.
    """
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        stock[length] = n
    patterns = length_patterns(capacity, stock > 0)
    repeats = np.floor(nnls(patterns, stock.astype(float)) + 1e-6).astype(np.int64) if len(patterns) else np.zeros(0, np.int64)
    groups: list[tuple[tuple[int, ...], int]] = []  # lengths within a sequence, how many such sequences
    for j in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
        pattern = [int(x) for x in patterns[j] if x > 0]
        n = min(int(repeats[j]), *(int(stock[x]) // pattern.count(x) for x in pattern))
        if n > 0:
            for x in pattern:
                stock[x] -= n
            groups.append((tuple(pattern), n))
    # Best fit of the residual, longest first, into the room of open sequences or new ones.
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        r = capacity - sum(lengths)
        if not room[r]:
            bisect.insort(rooms, r)
        room[r].append((lengths, n))

    for lengths, n in groups:
        put(lengths, n)
    for length in range(capacity, 0, -1):
        n = int(stock[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, over = divmod(n, each)
                if full:
                    put((length,) * each, full)
                if over:
                    put((length,) * over, 1)
                break
            r = rooms[at]
            lengths, m = room[r].pop()
            if not room[r]:
                rooms.pop(at)
            used = min(n, m)
            if m > used:
                put(lengths, m - used)
            put((*lengths, length), used)
            n -= used
    plan, sequence, taken = [], 0, defaultdict(int)
    for r in sorted(room):
        for lengths, n in room[r]:
            offset = 0
            for length in lengths:
                plan.append((length, taken[length], n, sequence, offset))
                taken[length] += n
                offset += length
            sequence += n
    return plan


_ENCODERS: dict[str, ChunkEncoder] = {}


def library_encoder(json_path: str, pattern: str) -> ChunkEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without its post-processing.

    Its added tokens keep their ids wherever they occur. Where tokens are numbered in the order of their merges, as
    in published files, the numbers are the ranks of the merges, and tiktoken encodes new chunks, joined by spaces,
    from these same ranks; else the library's own model is asked for each piece.
    """
    if json_path not in _ENCODERS:
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        whole, vocab = Tokenizer.from_file(json_path), model["vocab"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as they are
        shown = {b: chr(b) for b in kept} | {
            b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made == sorted(made) and len(set(vocab) - set(added)) == len(made) + 256:
            encode: EncodeChunks = _by_ranks({bytes(map({c: b for b, c in shown.items()}.__getitem__, t)): i for t, i in vocab.items() if t not in added}, pattern)
        else:
            def pieces(found: list[str]) -> list[bytes]:
                names = (p.encode().decode("latin-1").translate(shown) for p in found)
                return [pack_ids("<%dI" % len(ids), *ids) for ids in ([t.id for t in whole.model.tokenize(name)] for name in names)]

            encode = PieceEncoder(pattern, pieces)
        _ENCODERS[json_path] = ChunkEncoder(encode, added)
    return _ENCODERS[json_path]


def _by_ranks(ranks: dict[bytes, int], pattern: str) -> EncodeChunks:
    import tiktoken

    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    opens = np.zeros(max(ranks.values()) + 1, bool)  # tokens that begin with a space, which is where a chunk begins
    opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def encode(chunks: list[str], heads: bool) -> tuple[np.ndarray, np.ndarray]:
        if heads:
            found = [library.encode_to_numpy(c, disallowed_special=()) for c in chunks]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))
        # A chunk holds no space, but it may end in other white space: the last of its text, so encoded alone.
        alone = [i for i, c in enumerate(chunks) if c[-1].isspace() or " " in c]
        if alone:
            found = [encode([c], True) for c in (" " + c for c in chunks)]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = library.encode_to_numpy(" " + " ".join(chunks), disallowed_special=())
        sizes = np.diff(np.append(np.flatnonzero(opens[ids]), len(ids)))
        if len(sizes) != len(chunks):
            raise AssertionError("a chunk does not begin with a space")
        return ids, sizes

    return encode


def cut_pieces(cuts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of each piece of texts whose ids lie at ``cuts``.

    A text's first piece takes the remainder, so that all the others are full.
    """
    total = np.diff(cuts)
    count = -(-total // capacity)
    row = np.repeat(np.arange(len(total)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = ((total - 1) % capacity + 1)[row]
    return row, piece, np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)


def token_pieces(docs: DataFrame, json_path: str, pattern: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth: pieces, each numbered within its task and length.

    A document's ids are its tokens, then ``end``. Only a document longer than ``capacity`` is cut; its
    first piece takes the remainder, so that all the others are full.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(json_path, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in byte_slices(batch, 1, TEXT_BYTES):
                ids, cuts = encoder.encode(as_strings(part.column(1)))
                ids = np.insert(ids, cuts[1:], np.uint32(end)).astype("<u4")
                cuts = cuts + np.arange(len(cuts))
                row, piece, start, length = cut_pieces(cuts, capacity)
                data, at = memoryview(ids).cast("B"), 4 * (cuts[row] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sizes, begins, counts = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) + np.repeat(seen[sizes] - begins, counts)
                seen[sizes] += counts
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(nth),
                     pa.array(np.full(len(row), task))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])
        encoder.release()

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task long")


def pack(docs: DataFrame, json_path: str, pattern: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Null text counts as empty (its one piece is the end id). Repeated rows are packed as often as they
    occur. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, json_path, pattern, capacity, end))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = plan_packing(histogram, capacity)
    plan.sort()
    lengths = np.array([p[0] for p in plan], np.int64)
    table = np.array([p[1:] for p in plan], np.int64).reshape(-1, 4)
    first = np.searchsorted(lengths, np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((first, table))  # bounded: runs of at most `capacity` lengths
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, table = shared.value
        big = np.int64(1) << 40
        keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * big + table[:, 0]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(keys, length * big + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table[at, 2] + rank - table[at, 0]), pa.array(table[at, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets.select("task", "length", "before"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
