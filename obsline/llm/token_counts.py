"""Token counts by finite-state transducers (operator 12).

Two deterministic transducers read a text. The first reads classes of characters and says which characters
end a word, as the file's split pattern does. It has six states, so each chunk of characters has a complete
state map; the maps of all chunks of a batch compose through a parallel prefix scan, which gives the state at
which each chunk starts, and a second reading says where words end.

The second reads the bytes of words, the last byte of each marked, and says how many tokens they make.
A sequence of tokens is what the merges give if and only if every two neighbours are, for merges whose
ranks rise (checked when a file is read). So the last token of each prefix, and how many tokens it has, follow
from the last tokens of shorter prefixes from which a token may still grow. These are a state, of which there are finitely many;
each transition carries the number of tokens that it adds (less than zero where a merge reaches back). States and
transitions are made when they are first met and live in dense arrays, as many as ``MOST_STATES``, then anew. A
chunk of bytes that starts inside a word has a partial state map: its entries are the states that a reading
of the bytes before suggests, and those that its predecessor's map in fact leads to.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.llm.common import byte_slices, small_batches, text_bytes

#: Bytes of text that are read at a time; a longer text is read in pieces.
TEXT_BYTES = 1 << 19
#: Characters, and bytes of words, to a chunk.
CHARS, BYTES = 64, 64
#: Bytes of words that are read between two looks at the number of states.
STREAM = 1 << 16
#: States that are kept; beyond, the transducer starts anew.
MOST_STATES = 1 << 15
#: Tokens whose followers are kept.
KEPT = 1 << 14
NEVER = 1 << 30

# ---- the first transducer: where words end
# The split pattern and the normalisation that the classes and states below stand for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPACES = "\t\n\v\f\r \x85\xa0                　"

SPACE, LETTER, NUMBER, OTHER, QUOTE, ENDS, R_OR_V, L, E = range(9)
CLASSES = 16  # with room, so that (state, class) is one byte
NEWER = 16  # a bit of the class of characters that Python's tables do not know
UNSEEN = 255
BETWEEN, WORD, SIGNS, QUOTED, WANTS_E, WANTS_L = range(6)
LAST, BEFORE_LAST, THIS = 1, 2, 4  # which character a transition marks as the end of a word


def _word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of (state, class)."""
    follow, marks = np.zeros((6, CLASSES), np.uint8), np.zeros((6, CLASSES), np.uint8)
    letters = (LETTER, ENDS, R_OR_V, L, E)

    def put(state: int, kinds: tuple[int, ...], to: int, mark: int) -> None:
        for kind in kinds:
            follow[state, kind], marks[state, kind] = to, mark

    for state, open_, back in ((BETWEEN, 0, 0), (WORD, LAST, 0), (SIGNS, LAST, 0), (QUOTED, LAST, 0), (WANTS_E, LAST, BEFORE_LAST), (WANTS_L, LAST, BEFORE_LAST)):
        put(state, letters, WORD, open_ if state in (BETWEEN, SIGNS, QUOTED) else back)
        put(state, (SPACE,), BETWEEN, open_ | back)
        put(state, (NUMBER,), BETWEEN, open_ | back | THIS)
        put(state, (OTHER,), SIGNS, 0 if state in (SIGNS, QUOTED) else open_ | back)
        put(state, (QUOTE,), SIGNS if state in (SIGNS, QUOTED) else QUOTED, 0 if state in (SIGNS, QUOTED) else open_ | back)
    put(QUOTED, (ENDS,), BETWEEN, THIS)  # 's 't 'm 'd
    put(QUOTED, (R_OR_V,), WANTS_E, 0)
    put(QUOTED, (L,), WANTS_L, 0)
    put(WANTS_E, (E,), BETWEEN, THIS)  # 're 've
    put(WANTS_L, (L,), BETWEEN, THIS)  # 'll
    return follow.ravel(), marks.ravel()


FOLLOW, MARKS = _word_transducer()


def word_ends(classes: np.ndarray) -> np.ndarray:
    """Which characters end a word; the last one must be a space."""
    n = len(classes)
    chunks = -(-n // CHARS)
    grid = np.full(chunks * CHARS, SPACE, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(chunks, CHARS).T)
    maps = np.tile(np.arange(6, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = FOLLOW[(maps << 4) | column[:, None]]
    # Parallel prefix scan: after the step of width w, a map stands for its chunk and the 2 w - 1 before it.
    width = 1
    while width < chunks:
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.intp), axis=1)
        width *= 2
    state = np.concatenate([[np.uint8(BETWEEN)], maps[:-1, BETWEEN]]).astype(np.uint8)
    marks = np.empty_like(columns)
    for j, column in enumerate(columns):
        at = (state << 4) | column
        marks[j], state = MARKS[at], FOLLOW[at]
    flat = marks.T.ravel()[:n]
    ends = (flat & THIS) > 0
    ends[:-1] |= (flat[1:] & LAST) > 0
    ends[:-2] |= (flat[2:] & BEFORE_LAST) > 0
    return ends


# ---- the second transducer: how many tokens

class Merges:
    """Merges of a file: symbols 0 to 255 are bytes inside a word, 256 to 511 last bytes, then a token a merge.

    Tokens stand in a trie of their symbols, numbered in depth-first order, so that the tokens below a node are a range.
    """

    def __init__(self, parts: list[tuple[int, int]]):
        size = 512 + len(parts)
        self.right_of = [-1] * 512 + [b for _, b in parts]
        left = np.array([-1] * 512 + [a for a, _ in parts])
        self.rank = np.arange(size) - 512
        self.partners: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a symbol: what it merges with, and the ranks
        of: dict[int, list[int]] = {}
        for rank, (a, _) in enumerate(parts):
            of.setdefault(a, []).append(rank)
        for a, ranks in of.items():
            self.partners[a] = np.array([parts[r][1] for r in ranks]), np.array(ranks)
        # Tokens by how many merges lie on their left edge, for computations from the byte up.
        depth = np.zeros(size, np.int32)
        for rank, (a, _) in enumerate(parts):
            depth[512 + rank] = depth[a] + 1
        self.levels = [(at, left[at]) for at in (np.flatnonzero(depth == d) for d in range(1, depth.max(initial=0) + 1))]
        texts: list[tuple[int, ...]] = [(s,) for s in range(512)]
        for a, b in parts:
            texts.append(texts[a] + texts[b])
        order = sorted(range(size), key=texts.__getitem__)
        self.place = np.empty(size, np.int64)
        self.place[order] = np.arange(size)
        # Nodes in depth-first order: (node, symbol) to node, a node's own token, and the range of places strictly below it.
        self.child: dict[int, int] = {}
        self.token_at, self.low, self.high = [-1], [0], [size]
        stack = [0]
        before: tuple[int, ...] = ()
        for at, token in enumerate(order):
            text = texts[token]
            shared = 0
            while shared < min(len(before), len(text)) and before[shared] == text[shared]:
                shared += 1
            for node in stack[shared + 1 :]:
                self.high[node] = at
            del stack[shared + 1 :]
            for s in text[shared:]:
                self.child[stack[-1] << 9 | s] = len(self.token_at)
                stack.append(len(self.token_at))
                self.token_at.append(-1)
                self.low.append(at)
                self.high.append(size)
            self.token_at[stack[-1]], self.low[stack[-1]] = token, at + 1
            before = text
        self.sound = self._sound(parts)

    def _first(self, token: int) -> np.ndarray:
        """Of each symbol, the least rank at which it merges with a symbol of the token's right edge, while that is whole."""
        first = np.full(len(self.rank), NEVER)
        ends = NEVER
        while token >= 0:
            if token in self.partners:
                others, ranks = self.partners[token]
                soon = ranks < ends
                first[others[soon]] = np.minimum(first[others[soon]], ranks[soon])
            ends, token = self.rank[token], self.right_of[token]
        return first

    def _sound(self, parts: list[tuple[int, int]]) -> np.ndarray:
        """Whether the merges make a token of its own text: its halves are sound, and nothing joins across them before."""
        rank_of = {pair: rank for rank, pair in enumerate(parts)}
        sound = np.ones(len(self.rank), bool)
        for rank, (a, b) in enumerate(parts):
            fine = sound[a] and sound[b]
            left, ends = a, rank
            while fine and left >= 0:
                right, starts = b, rank
                while fine and right >= 0:
                    met = rank_of.get((left, right), rank)
                    fine = met == rank or met >= ends or met > starts
                    starts, right = right - 512, parts[right - 512][0] if right >= 512 else -1
                ends, left = left - 512, self.right_of[left]
            sound[512 + rank] = fine
        return sound

    def after(self, last: int) -> np.ndarray:
        """A packed bit by place: 1 for tokens that can stand after the token ``last``, which the merges keep apart from it.

        At any rank one symbol of the left token's right edge meets one of the right token's left edge. They merge if
        their pair's rank comes before both go into their own tokens; of equal ranks the pair further left goes first.
        """
        first = self._first(last)
        joined = np.zeros(len(self.rank), bool)
        for tokens, left in self.levels:
            joined[tokens] = joined[left] | (first[left] <= self.rank[tokens])
        out = np.zeros(len(self.rank), np.uint8)
        out[self.place] = self.sound & ~joined & (first == NEVER)
        return np.packbits(out)


class Counter:
    """The second transducer, made as far as it has been needed.

    A state is a list of entries (node of the symbols since a place, kind of the last token before that place, tokens
    there less tokens here), for the places from which a token may still grow. Last tokens are of one kind at a node
    if the same tokens below it can follow.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.to = np.full((64, 512), -1, np.int32)
        self.adds = np.zeros((64, 512), np.int8)
        self.kinds: dict[tuple[int, int], int] = {}
        self.first_of: dict[tuple[int, bytes], int] = {}
        self.after_of: dict[int, np.ndarray] = {}

    def _after(self, last: int) -> np.ndarray:
        found = self.after_of.get(last)
        if found is None:
            if len(self.after_of) >= KEPT:
                self.after_of.clear()
            found = self.after_of[last] = self.merges.after(last)
        return found

    def _follows(self, last: int, token: int) -> int:
        at = int(self.merges.place[token])
        return self._after(last)[at >> 3] >> (7 - (at & 7)) & 1

    def _kind(self, last: int, node: int) -> int:
        """The first token that leaves the same choice below the node as ``last`` does; -2 if there is none."""
        m = self.merges
        if last == -1:
            return -1 if m.low[node] < m.high[node] else -2
        kind = self.kinds.get((last, node))
        if kind is None:
            low, high = m.low[node], m.high[node]
            below = np.unpackbits(self._after(last)[low >> 3 : (high + 7) >> 3])[low & 7 :][: high - low]
            kind = self.kinds[last, node] = self.first_of.setdefault((node, _digest(np.packbits(below).tobytes())), last) if below.any() else -2
        return kind

    def _step(self, state: int, symbol: int) -> None:
        m = self.merges
        reached = []
        token, count = -1, 0
        for node, last, tokens in self.states[state]:
            child = m.child.get(node << 9 | symbol)
            if child is None:
                continue
            own = m.token_at[child]
            if token < 0 and own >= 0 and (m.sound[own] if last < 0 else self._follows(last, own)):
                token, count = own, tokens + 1
            reached.append((child, last, tokens))
        if symbol >= 256:
            to = 0
        else:
            entries = [(child, self._kind(last, child), tokens - count) for child, last, tokens in reached]
            key = (*(e for e in entries if e[1] != -2), (0, self._kind(token, 0), 0))
            to = self.number.setdefault(key, len(self.states))
            if to == len(self.states):
                self.states.append(key)
                if to == len(self.to):
                    self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                    self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        self.to[state, symbol], self.adds[state, symbol] = to, count

    def run(self, symbols: np.ndarray, at: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of chunks, all read in step."""
        order = np.argsort(-lengths, kind="stable")
        at, lengths, state = at[order], lengths[order], state[order].astype(np.int64)
        added = np.zeros(len(at), np.int64)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for j, n in enumerate(active):
            key = state[:n] << 9 | symbols[at[:n] + j]
            to = self.to.reshape(-1)[key]
            if to.min(initial=0) < 0:
                for k in np.unique(key[to < 0]).tolist():
                    self._step(k >> 9, k & 511)
                to = self.to.reshape(-1)[key]
            added[:n] += self.adds.reshape(-1)[key]
            state[:n] = to
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], added[back]

    def counts(self, symbols: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Tokens of each owner; the symbols of an owner follow each other and end with a word."""
        n = len(symbols)
        if not n:
            return np.zeros(owners, np.int64)
        if len(self.states) > MOST_STATES:
            self.clear()
        begins = np.concatenate([[0], np.flatnonzero(symbols >= 256) + 1])  # where words begin, and the end
        cuts = np.arange(0, n, BYTES)
        after = begins[np.searchsorted(begins, cuts)]
        # An owner's first word begins a chunk as well, so that a chunk has one owner.
        cuts = np.unique(np.concatenate([np.where(after - cuts < BYTES, after, cuts), np.flatnonzero(np.diff(owner)) + 1]))
        cuts = cuts[cuts < n]
        lengths = np.diff(np.append(cuts, n))
        known = np.zeros(len(cuts), bool)
        known[np.searchsorted(cuts, begins[np.isin(begins, cuts)])] = True
        entry = np.zeros(len(cuts), np.int64)
        if not known.all():
            # Chunks that start inside a word: the bytes before suggest the state.
            inside = np.flatnonzero(~known)
            entry[inside], _ = self.run(symbols, cuts[inside] - BYTES, np.full(len(inside), BYTES), np.zeros(len(inside), np.int64))
        end, added = self.run(symbols, cuts, lengths, entry)
        while not known.all():
            wrong = np.flatnonzero(~known & (np.concatenate([[0], end[:-1]]) != entry))
            if not len(wrong):
                break
            entry[wrong] = end[wrong - 1]
            end[wrong], added[wrong] = self.run(symbols, cuts[wrong], lengths[wrong], entry[wrong])
        return np.bincount(owner[cuts], added, owners).astype(np.int64)


def _digest(data: bytes) -> bytes:
    return data if len(data) <= 16 else hashlib.blake2b(data, digest_size=16).digest() + b"-"


# ---- a file's tokenizer

class Tokens:
    """Counts tokens as the file's own library does with ``add_special_tokens=False``."""

    def __init__(self, text: str):
        told = json.loads(text)
        model = told["model"]
        steps, splits = ((told[a] or {}).get(b, []) for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        plain = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model["dropout"] and not model["ignore_merges"]
            and not model["continuing_subword_prefix"]
            and [s["type"] for s in steps] == NORMALISERS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": PATTERN}
            and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
            and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"])
        )
        if not plain:
            raise ValueError("a file of another kind: lower-case words with byte-level merges and </w> are expected")
        symbol = {}
        for byte, char in enumerate(_byte_chars()):
            symbol[char], symbol[char + "</w>"] = byte, 256 + byte
        if not symbol.keys() <= model["vocab"].keys():
            raise ValueError("a byte without a token")
        parts = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a not in symbol or b not in symbol or symbol.setdefault(a + b, 512 + len(parts)) != 512 + len(parts):
                raise ValueError("merges whose ranks do not rise, or with one result")
            parts.append((symbol[a], symbol[b]))
        self.counter = Counter(Merges(parts))
        self.text = text
        added = sorted((a["content"] for a in told["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        for chars, kind in ((SPACES, SPACE), ("'", QUOTE), ("stmd", ENDS), ("rv", R_OR_V), ("l", L), ("e", E)):
            self.classes[[ord(c) for c in chars]] = kind
        self._library = None

    @property
    def library(self):
        """The library's tokenizer, for characters that are newer than Python's tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.text)
        return self._library

    def _class(self, code: int) -> int:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cn":
            split = self.library.pre_tokenizer.pre_tokenize_str
            return NEWER | (LETTER if len(split(char + "a")) == 1 else NUMBER if len(split(char + "!")) == 2 else OTHER)
        return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)

    def _classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found = self.classes[codes]
        if (found == UNSEEN).any():
            for code in np.unique(codes[found == UNSEEN]).tolist():
                self.classes[code] = self._class(code)
            found = self.classes[codes]
        return found

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # character by character: a final sigma is none
        if (self._classes(plain) & NEWER).any():
            return self.library.normalizer.normalize_str(text)
        return plain

    def count(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                owners = [i for i, _ in held]
                np.add.at(counts, owners, self._counts([piece for _, piece in held]))
                held.clear()
                size = 0

        for i, text in enumerate(texts):
            for part in pieces(text, TEXT_BYTES):
                if self.added and (found := self.added.findall(part)):
                    counts[i] += len(found)
                    part = " ".join(map(self._normal, self.added.split(part)))
                else:
                    part = self._normal(part)
                held.append((i, part))
                size += len(part)
                if size >= TEXT_BYTES:
                    flush()
        flush()
        return counts

    def _counts(self, parts: list[str]) -> np.ndarray:
        joined = " ".join(parts) + " "
        classes = self._classes(joined) & ~np.uint8(NEWER)
        ends, kept = word_ends(classes), classes != SPACE
        of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) + 1 for p in parts])
        data = np.frombuffer(joined.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) - 1
        last = np.append(char[1:] != char[:-1], True)
        keep = kept[char]
        symbols = (data + 256 * (last & ends[char]).astype(np.int64))[keep]
        owner = of[char[keep]]
        total = np.zeros(len(parts), np.int64)
        at = 0
        while at < len(symbols):
            stop = min(at + STREAM, len(symbols))
            if stop < len(symbols):  # to the end of the word
                stop += int(np.argmax(symbols[stop - 1 :] >= 256))
            first = owner[at]
            total[first : owner[stop - 1] + 1] += self.counter.counts(symbols[at:stop], owner[at:stop] - first, int(owner[stop - 1] - first) + 1)
            at = stop
        return total


def _byte_chars() -> list[str]:
    """The characters that stand for bytes in files of byte-level merges: printable ones for themselves, others from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def pieces(text: str, most: int) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut before white space of ASCII, where nothing joins."""
    at = 0
    blank = re.compile(r"[\t\n\v\f\r ]")
    while len(text) - at > most:
        found = blank.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


_MADE: dict[str, Tokens] = {}


def _tokens(text: str) -> Tokens:
    """A worker makes the transducers once and keeps those of the last file."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokens(text)
    return _MADE[key]


def token_counts(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, and n_bytes (of UTF-8) and n_tokens of every text.

    ``path`` names a tokenizer file of byte-level merges over lower-case words. Tokens are those of its library
    without special tokens around; strings of special tokens inside a text count as one token each. A null text is
    an empty one: no bytes, no tokens. Rows that repeat are counted each; other columns are not read. No rows
    give an empty result. A text is read whole, in pieces of bounded size unless it has no white space.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as lines:
        told = spark.sparkContext.broadcast(lines.read())
    plain = docs.select(*carry, F.octet_length(text_bytes(text)).cast("long").alias("n_bytes"), text_bytes(text).alias("_text"))
    schema = plain.drop("_text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(told.value)
        for batch in batches:
            for part in byte_slices(batch, len(batch.columns) - 1, TEXT_BYTES):
                texts = part.column(len(part.columns) - 1).cast(pa.string()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(tokens.count(texts))], schema.names)

    return plain.mapInArrow(run, schema)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
