"""Byte-level BPE by padded numpy matrices (operator 7), and the chunk store that operator 10 shares.

A text is cut at single spaces between non-space characters, where no match of the split pattern can
cross. Arrow cuts a batch of texts and numbers its distinct chunks, so Python sees each chunk once a batch;
a bounded store keeps the ids of chunks seen before. Chunks that are not in the store are split by the
pattern, and their distinct pieces are encoded together in matrices. Ids of whole texts are then gathered
by offsets.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.llm.common import byte_slices, small_batches, text_bytes

#: Rows of more columns merge all places of their least pair in a round, if that is proved to give the same for the file.
SINGLE_MERGE = 64
#: Cells of one matrix; a piece with more has a matrix of its own.
MATRIX_CELLS = 1 << 20
#: Bytes, as estimated, that a worker's store may hold before it starts anew.
STORE_BYTES = 64 << 20
#: Bytes of text that are encoded at a time (a longer text is taken alone).
TEXT_BYTES = 2 << 20
NO_RANK = np.int32(2**31 - 1)
UNSAFE = -1
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def exact_spaces(pattern: str) -> str:
    """The pattern with white space as Unicode defines it (without the separators x1c to x1f)."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Hashed lookup of (left id, right id) to the id of the joined token, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slot(keys)
        while len(keys):  # each round places the first claimant of every free slot
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            wins = np.zeros(len(keys), bool)
            wins[first] = True
            wins &= free
            self.keys[slots[wins]], self.ranks[slots[wins]] = keys[wins], values[wins]
            keys, values, slots = keys[~wins], values[~wins], (slots[~wins] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined pairs, NO_RANK where a pair does not join (or an id is negative)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(keys[todo])
        while len(todo):
            held = self.keys[slots]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != -1)
            todo, slots = todo[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def _single_states(text: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[list[bytes], int]]:
    """The tokens of a text before each merge of the leftmost least pair, and that pair's rank."""
    tokens = [text[i : i + 1] for i in range(len(text))]
    while len(tokens) > 1:
        found = [ranks.get(a + b, NO_RANK) for a, b in zip(tokens, tokens[1:], strict=False)]
        least = min(found)
        if least == NO_RANK:
            return
        yield tokens, least
        at = found.index(least)
        tokens = [*tokens[:at], tokens[at] + tokens[at + 1], *tokens[at + 2 :]]


def merges_go_together(ranks: dict[bytes, int]) -> bool:
    """Whether merging all places of a least pair at once, from the left, always gives what single merges give.

    It may differ only where a merge of (x, y) leads to a token t that joins, at a lower rank, the x of a later place: then t
    holds xy, and t x is a token with a lower rank than xy. Up to then nothing has crossed the edges of t x y, so single merges of
    that text alone pass through the same tokens. So it is enough to see, for each such t, whether they do.
    """
    for whole, rank in ranks.items():
        for cut in range(1, len(whole)):
            t, x = whole[:cut], whole[cut:]
            if t not in ranks or x not in ranks:
                continue
            at = t.find(x)
            while at >= 0:
                for end in range(at + len(x) + 1, len(t) + 1):
                    y = t[at + len(x) : end]
                    if y in ranks and ranks.get(x + y, -1) > rank:
                        for tokens, least in _single_states(t + x + y, ranks):
                            pairs = [pair == (x, y) for pair in zip(tokens, tokens[1:], strict=False)]
                            if least == ranks[x + y] and pairs[-1] and sum(pairs) > 1:
                                return False
                at = t.find(x, at + 1)
    return True


class MatrixBpe:
    """Encodes many byte pieces at once: one padded matrix for each length bucket, whatever the length."""

    def __init__(self, ranks: dict[bytes, int]):
        self.given = ranks
        self._together: bool | None = None
        self.table = PairTable(ranks)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("every single byte needs a rank")

    @property
    def together(self) -> bool:
        """merges_go_together of the ranks, looked into when a wide row comes."""
        if self._together is None:
            self._together = merges_go_together(self.given)
        return self._together

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low, high, most = 0, 4, lengths.max(initial=0)
        while low < most:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            step = max(1, MATRIX_CELLS // high)
            merge = self._single if high <= SINGLE_MERGE or not self.together else self._every
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                ids, ranks = self._matrix([pieces[i] for i in part], int(lengths[part].max()))
                for i, found in zip(part, merge(ids, ranks), strict=True):
                    out[i] = found
            low, high = high, high * 2
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, padded with -1, and the ranks of the pair that starts in each column."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, NO_RANK, np.int32)
        ranks[:, :-1] = self.table.find(ids[:, :-1], ids[:, 1:])
        return ids, ranks

    def _single(self, ids: np.ndarray, ranks: np.ndarray) -> list[bytes]:
        """Every row merges its leftmost least pair each round."""
        done = [b""] * len(ids)
        names, width = np.arange(len(ids)), ids.shape[1]
        columns = np.arange(width)
        while len(ids):
            best = ranks.argmin(axis=1)  # the leftmost of the least
            rows = np.arange(len(ids))
            least = ranks[rows, best]
            over = least == NO_RANK
            if over.any():  # compaction: rows that cannot merge leave the matrix
                counts = (ids[over] >= 0).sum(axis=1)
                for name, row, n in zip(names[over], ids[over].astype("<u4"), counts, strict=True):
                    done[name] = row[:n].tobytes()
                ids, ranks, names, best, least = ids[~over], ranks[~over], names[~over], best[~over], least[~over]
                rows = np.arange(len(ids))
                if not len(ids):
                    break
            ids[rows, best] = least
            # Everything right of the merged pair moves one column to the left.
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NO_RANK
            after = np.where(best + 1 < width, ids[rows, np.minimum(best + 1, width - 1)], -1)
            ranks[rows, best] = self.table.find(least, after)
            prior = best > 0
            ranks[rows[prior], best[prior] - 1] = self.table.find(ids[rows[prior], best[prior] - 1], least[prior])
        return done

    def _every(self, ids: np.ndarray, ranks: np.ndarray) -> list[bytes]:
        """Every row merges all places of its least pair each round, from the left.

        merges_go_together has proved for the ranks that single merges give the same; long rows would cost their square
        with these. Rows lose their tails as they shrink.
        """
        done = [b""] * len(ids)
        names = np.arange(len(ids))
        while len(ids):
            least = ranks.min(axis=1)
            over = least == NO_RANK
            if over.any():
                counts = (ids[over] >= 0).sum(axis=1)
                for name, row, n in zip(names[over], ids[over].astype("<u4"), counts, strict=True):
                    done[name] = row[:n].tobytes()
                ids, ranks, names, least = ids[~over], ranks[~over], names[~over], least[~over]
                if not len(ids):
                    break
            hit = ranks == least[:, None]
            row, col = np.nonzero(hit)
            # In a run such as a a a a every second place merges: count places within runs of neighbours.
            starts = np.ones(len(row), bool)
            starts[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
            at = np.arange(len(row))
            taken = (at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0
            row, col = row[taken], col[taken]
            ids[row, col] = least[row]
            fresh, alive = np.zeros(ids.shape, bool), ids >= 0
            fresh[row, col] = True
            alive[row, col + 1] = False
            counts = alive.sum(axis=1)
            inside = np.arange(counts.max()) < counts[:, None]
            ids, ranks, fresh = (self._left(x, alive, inside, fill) for x, fill in ((ids, -1), (ranks, NO_RANK), (fresh, False)))
            row, col = np.nonzero(fresh)
            for r, c in ((row, col), (row[col > 0], col[col > 0] - 1)):
                after = np.where(c + 1 < ids.shape[1], ids[r, np.minimum(c + 1, ids.shape[1] - 1)], -1)
                ranks[r, c] = self.table.find(ids[r, c], after)
        return done

    @staticmethod
    def _left(cells: np.ndarray, alive: np.ndarray, inside: np.ndarray, fill: int | bool) -> np.ndarray:
        out = np.full(inside.shape, fill, cells.dtype)
        out[inside] = cells[alive]
        return out


#: Chunks that follow a space (without it), or the heads of texts, to their ids in one array and the number of ids of each.
EncodeChunks = Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]]


class PieceEncoder:
    """Encodes chunks by the pieces of the split pattern, which are kept: words repeat in many chunks."""

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[bytes]], store_bytes: int = STORE_BYTES // 2):
        self.split = regex.compile(exact_spaces(pattern)).findall
        self.encode_pieces, self.store_bytes = encode_pieces, store_bytes
        # Under such a pattern a word after a space is one piece, and a mark after it another.
        self.wordwise = r"| ?\p{L}+|" in pattern and r"| ?[^\s\p{L}\p{N}]+|" in pattern
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def _cut(self, chunk: str) -> list[str] | tuple[str, ...]:
        if self.wordwise:
            if chunk.isalpha():
                return (" " + chunk,)
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return (" " + chunk[:-1], chunk[-1])
        return self.split(" " + chunk)

    def clear(self) -> None:
        self.pieces, self.held = {}, 0

    def __call__(self, chunks: list[str], heads: bool) -> tuple[np.ndarray, np.ndarray]:
        if self.held > self.store_bytes:
            self.clear()
        lists = list(map(self.split if heads else self._cut, chunks))
        new = list(set().union(*lists) - self.pieces.keys())
        found = self.encode_pieces(new)
        self.pieces.update(zip(new, found, strict=True))
        self.held += sum(map(len, new)) + sum(map(len, found)) + 160 * len(new)
        find = self.pieces.__getitem__
        packed = [find(p[0]) if len(p) == 1 else b"".join(map(find, p)) for p in lists]
        return np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4


class ChunkEncoder:
    """Ids of whole texts, by a bounded store of chunks over an encoder of chunks.

    ``added`` are strings that have an id of their own wherever they occur; texts are split there first.
    """

    def __init__(self, encode_chunks: EncodeChunks, added: dict[str, int] | None = None, store_bytes: int = STORE_BYTES):
        self.encode_chunks = encode_chunks
        self.added = added or {}
        self.added_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.store_bytes = store_bytes
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, int] = {}  # slots of chunks that follow a space, without it
        self.start, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.slots = self.end = self.held = 0

    def release(self) -> None:
        """Give memory back at the end of a task: Spark uses a worker again, for tasks of other kinds too."""
        self._clear()
        if isinstance(self.encode_chunks, PieceEncoder):
            self.encode_chunks.clear()
        pa.default_memory_pool().release_unused()

    def _put(self, chunks: list[str], heads: bool = False) -> np.ndarray:
        """Slots of the store for new chunks."""
        data, sizes = self.encode_chunks(chunks, heads)
        while self.slots + len(chunks) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.end + len(data) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        slots = np.arange(self.slots, self.slots + len(chunks))
        self.start[slots] = self.end + np.cumsum(sizes) - sizes
        self.size[slots] = sizes
        self.ids[self.end : self.end + len(data)] = data
        self.slots, self.end = self.slots + len(chunks), self.end + len(data)
        self.held += 4 * len(data) + 8 * len(chunks)
        return slots

    def _chunk_slots(self, chunks: list[str], last: bool = False) -> np.ndarray:
        """Slots of chunks that follow a space; UNSAFE where a chunk is empty or may meet more white space.

        With ``last`` chunks that end in white space are known to end their texts.
        """
        get = self.chunks.get
        out = np.fromiter((get(c, -2) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(out == -2)
        names = [chunks[i] for i in new]
        safe = np.fromiter((bool(c) and not c[0].isspace() and (last or not c[-1].isspace()) for c in names), bool, len(names))
        out[new] = UNSAFE
        names = [c for c, ok in zip(names, safe, strict=True) if ok]
        slots = self._put(names)
        out[new[safe]] = slots
        self.chunks.update((c, at) for c, at in zip(names, slots.tolist(), strict=True) if not c[-1].isspace())
        self.held += sum(map(len, names)) + 150 * len(names)
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, and where each text's begin (and the last one's end)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        heads = lists.values.take(pa.array(cuts[:-1])).to_pylist()
        of_code = self._chunk_slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sequence = of_code[codes]
        unsafe = sequence == UNSAFE
        unsafe[cuts[:-1]] = [bool(h) and h[-1].isspace() for h in heads]
        counts = np.diff(cuts)
        bad = np.logical_or.reduceat(unsafe, cuts[:-1]) & (counts > 1)
        if bad.any():  # cut these with an eye on all white space
            parts = [_SAFE_CUT.split(texts[int(i)].as_py()) for i in np.flatnonzero(bad)]
            slots = self._chunk_slots([c for p in parts for c in p], last=True)
            kept = sequence[np.repeat(~bad, counts)]
            for i, p in zip(np.flatnonzero(bad), parts, strict=True):
                heads[i] = p[0]
            counts[bad] = list(map(len, parts))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            sequence = np.empty(cuts[-1], np.int64)
            good = np.repeat(~bad, counts)
            sequence[good], sequence[~good] = kept, slots
        sequence[cuts[:-1]] = self._put(heads, heads=True)
        sizes = self.size[sequence]
        ends = np.cumsum(sizes, dtype=np.int64)
        source = np.repeat(self.start[sequence] - (ends - sizes), sizes)
        source += np.arange(len(source))
        return self.ids.take(source), np.concatenate([[0], ends])[cuts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a string array without nulls) in one array, and the offsets of each text's."""
        if self.held > self.store_bytes:
            self._clear()
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= np.asarray(pc.match_substring(texts, token))
        if not marked.any():
            return self._plain(texts)
        parts = [self.added_cut.split(t.as_py()) if m else [t] for t, m in zip(texts, marked, strict=True)]
        ids, cuts = self._plain(pa.array([p if isinstance(p, str) else p.as_py() for part in parts for p in part[::2]], pa.string()))
        counts = np.array([len(p) // 2 + 1 for p in parts])
        ends = np.cumsum(counts)
        inner = np.ones(len(cuts) - 1, bool)
        inner[ends - 1] = False  # the end of a text, not the place of an added token
        ids = np.insert(ids, cuts[1:][inner], np.array([self.added[x] for part in parts for x in part[1::2]], ids.dtype))
        return ids, np.concatenate([[0], cuts[ends] + np.cumsum(counts - 1)])


def as_strings(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes to strings; bytes that are no UTF-8 are replaced."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([str(t, "utf-8", "replace") for t in texts.to_pylist()], pa.string())


def as_binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array of bytes as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


_ENCODERS: dict[tuple, tuple[ChunkEncoder, pa.Array]] = {}


def matrix_encoder(path: str, pattern: str) -> tuple[ChunkEncoder, pa.Array]:
    """The worker's encoder for a rank file, and the bytes of each id."""
    if (path, pattern) not in _ENCODERS:
        ranks = read_ranks(path)
        model = MatrixBpe(ranks)
        names = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        _ENCODERS[path, pattern] = (
            ChunkEncoder(PieceEncoder(pattern, lambda pieces: model.encode([p.encode() for p in pieces]))), pa.array(names, pa.binary()))
    return _ENCODERS[path, pattern]


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids (packed binary) and decoded (bytes) to (doc_id); one row for each input row.

    Null text counts as empty and gives no ids. Texts of any length are encoded whole. Repeated rows
    stay repeated; other columns, whatever their names, are not read. A row never leaves its partition,
    so the operator has no shuffle and no skew beyond the input's own.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = matrix_encoder(rank_path, pattern)
        for batch in batches:
            for part in byte_slices(batch, 1, TEXT_BYTES):
                ids, cuts = encoder.encode(as_strings(part.column(1)))
                decoded = names.take(pa.array(ids))
                ends = np.frombuffer(decoded.buffers()[1], np.int32, len(decoded) + 1) if len(decoded) else np.zeros(1, np.int32)
                data = np.frombuffer(decoded.buffers()[2], np.uint8) if len(decoded) else np.zeros(0, np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), as_binary(ids, cuts * 4), as_binary(data, ends[cuts])], ["doc_id", "ids", "decoded"])
        encoder.release()

    return docs.select(F.col("doc_id"), text_bytes(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode's rows."""
    return coded.select(
        "doc_id", F.expr("CAST(length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def reference_digest(text: str, encode: Callable[[str], list[int]]) -> tuple[int, str]:
    """Token count and digest of one text by another encoder, for tests."""
    ids = np.array(encode(text), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest()
