"""Exact deduplication by Grace hashing (operator 8).

First pass, where the rows lie: each task folds equal contents into local groups by an open-addressing
table, so that a content leaves a task a few times at most, however many copies there are. It writes
one member row for each document and one content row for each local group.

Second pass: content rows are shuffled by their hash. A task deals them to spill files by further bits
of the hash, again and again until the distinct contents of a file fit the table's memory, and compares
complete contents there. It gives each local group its content's group: the row that stays and the size.

Members join these by the local group, a key that no content can make hot.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from obsline.llm.common import materialise, small_batches, text_bytes

#: Bytes of distinct content that a table may hold; beyond it, its rows are dealt to spill files.
TABLE_BYTES = 32 << 20
FAN_OUT = 16
#: Rows of a group that meet one copy of its least row.
SHARE = 10_000
SEED = 7

_SPACES = re.compile(rb"[\t-\r][ \t-\r]*| [ \t-\r]+")  # runs that are not yet one space
_HEAD = struct.Struct("<QqqqI")  # hash, group, first, uid, length of the content
_MANY = struct.Struct("<q")


def normalise(text: bytes) -> bytes:
    return _SPACES.sub(b" ", text)


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The content's entry, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.contents)
        self.slots[at] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry, True


Row = tuple[int, int, "int | None", int, int, bytes]  # hash, local group, least doc_id, its uid, rows, content


def _order(first: int | None, uid: int) -> tuple:
    """Least doc_id first; a null id comes last."""
    return (first is None, first or 0, uid)


def grace(rows: Iterable[Row], folder: str, budget: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(local group, uid that stays, its doc_id, size) for every row, by spill files below ``folder``.

    Rows are dealt by the hash's next four bits until the distinct contents of a file fit ``budget``;
    copies of one content share an entry and so never need a further split.
    """
    if level * 4 >= 64:  # all 64 bits agree: nothing more to deal by
        budget = 1 << 62
    table, groups, best = ContentTable(), [], []
    held = iter(rows)
    for row in held:
        h, group, first, uid, n, content = row
        entry, new = table.add(h >> 4 * level if level < 16 else h, content)
        if new:
            groups.append([])
            best.append([*_order(first, uid), 0, first])
        groups[entry].append(group)
        least = best[entry]
        if (key := _order(first, uid)) < tuple(least[:3]):
            least[:3], least[4] = key, first
        least[3] += n
        if table.bytes > budget and len(table.contents) > 1:
            break
    else:
        for members, least in zip(groups, best, strict=True):
            for group in members:
                yield group, least[2], least[4], least[3]
        return
    # Too much for one table: spill what it holds (folded) and the rest, and take file by file.
    names = [os.path.join(folder, f"{level}-{i}") for i in range(FAN_OUT)]
    stands: dict[int, list[int]] = {}  # groups of folded rows, by the one that is spilled for them
    files = [open(name, "wb") for name in names]
    try:
        for entry, members in enumerate(groups):
            least = best[entry]
            stands[members[0]] = members
            _spill(files, level, table.hashes[entry], members[0], least[4], least[2], least[3], table.contents[entry])
        del table, groups, best
        for h, group, first, uid, n, content in held:
            _spill(files, level, h >> 4 * level, group, first, uid, n, content)
    finally:
        for file in files:
            file.close()
    for name in names:
        below = os.path.join(folder, os.path.basename(name) + ".d")
        os.mkdir(below)
        for group, uid, first, n in grace(_unspill(name, level + 1), below, budget, level + 1):
            for member in stands.pop(group, (group,)):
                yield member, uid, first, n
        os.rmdir(below)
        os.remove(name)


def _spill(files: list, level: int, h: int, group: int, first: int | None, uid: int, n: int, content: bytes) -> None:
    file = files[h % FAN_OUT]
    file.write(_HEAD.pack(h >> 4, group, -1 if first is None else first, uid, len(content)))
    file.write(_MANY.pack(-n if first is None else n))
    file.write(content)


def _unspill(name: str, level: int) -> Iterator[Row]:
    with open(name, "rb") as file:
        while head := file.read(_HEAD.size):
            h, group, first, uid, size = _HEAD.unpack(head)
            (n,) = _MANY.unpack(file.read(_MANY.size))
            yield h << 4 * level, group, None if n < 0 else first, uid, abs(n), file.read(size)


def _whole(docs: DataFrame) -> bool:
    return isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType))


def local_groups(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """Member rows (doc_id, uid, local, sha) and content rows (local, first, uid, n, hash, content).

    Ids that are no integers are null here and stand in the column ``own`` of the members.

    Local groups and uids carry the task's number, so they do not clash. When the table is full, its
    groups are closed and later copies open new ones.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("local", pa.int64()), ("sha", pa.binary()),
                        ("n", pa.int64()), ("hash", pa.int64()), ("content", pa.binary())])
    whole = _whole(docs)
    ident = [F.col("doc_id").cast("long"), text_bytes().alias("text")] if whole else [F.lit(None).cast("long"), text_bytes().alias("text"), F.col("doc_id").alias("own")]
    plain = docs.select(*ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        uid, closed = base, base
        table, stats = ContentTable(), []

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(stats), 500):
                part = stats[at : at + 500]
                ids = range(closed + at, closed + at + len(part))
                yield with_own(
                    [pa.array([s[1] for s in part], pa.int64()), pa.array([s[2] for s in part], pa.int64()),
                     pa.array(ids, pa.int64()), pa.nulls(len(part), pa.binary()), pa.array([s[3] for s in part], pa.int64()),
                     pa.array([h - (1 << 64) if h >> 63 else h for h in table.hashes[at : at + len(part)]], pa.int64()),
                     pa.array(table.contents[at : at + len(part)], pa.binary())])

        def with_own(arrays: list[pa.Array], given: pa.Array | None = None) -> pa.RecordBatch:
            names = schema.names
            if not whole:
                arrays, names = [*arrays, pa.nulls(len(arrays[0]), kind) if given is None else given], [*names, "own"]
            return pa.RecordBatch.from_arrays(arrays, names)

        kind = None
        for batch in batches:
            locals_, shas, uids = [], [], []
            ids = batch.column(0).to_pylist()
            kind = None if whole else batch.column(2).type
            for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                content = normalise(text)
                entry, new = table.add(xxhash.xxh3_64_intdigest(content, SEED), content)
                if new:
                    stats.append([_order(doc_id, uid), doc_id, uid, 0, hashlib.sha256(content).digest()])
                stat = stats[entry]
                if (key := _order(doc_id, uid)) < stat[0]:
                    stat[:3] = key, doc_id, uid
                stat[3] += 1
                locals_.append(closed + entry)
                shas.append(stat[4])
                uids.append(uid)
                uid += 1
            n = len(ids)
            yield with_own(
                [pa.array(ids, pa.int64()), pa.array(uids, pa.int64()), pa.array(locals_, pa.int64()), pa.array(shas, pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], None if whole else batch.column(2))
            if table.bytes > budget:
                yield from flush()
                closed += len(stats)
                stats.clear()
                table.clear()
        yield from flush()

    more = "" if whole else f", own {docs.schema['doc_id'].dataType.simpleString()}"
    return plain.mapInArrow(run, "doc_id long, uid long, local long, sha binary, n long, hash long, content binary" + more)


def _least_own(members: DataFrame) -> DataFrame:
    """Rows of (own, group, group_size, uid, sha) with the least of their group's own ids and the row that has it.

    A group's least row is written once for each SHARE rows of the group, so that a large group's rows meet it in several tasks.
    """
    order = F.struct(F.col("own").isNull().alias("absent"), "own", "uid")
    part = F.expr(f"uid % (1 + group_size DIV {SHARE})")
    least = members.groupBy("group", "group_size").agg(F.min(order).alias("least"))
    least = least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"group_size DIV {SHARE}")))).drop("group_size")
    return members.withColumn("part", part).join(least, ["group", "part"])


def exact_groups(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.

    Texts are equal when they are after each run of ASCII white space became one space; null counts as
    empty. The row with the least doc_id stays; of fully repeated rows exactly one. Null ids count as
    the greatest. Ids may have any type that has an order and keep it. An empty table gives an
    empty result. Other columns are not read.
    """
    found = materialise(local_groups(docs, budget))
    contents = found.filter("content IS NOT NULL").select("hash", "local", "doc_id", "uid", "n", "content")
    schema = pa.schema([("local", pa.int64()), ("keep_uid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for h, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield (h % (1 << 64), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            out: list[tuple] = []
            for row in grace(rows(batches), folder, budget):
                out.append((row[0], row[1], row[2], row[3]))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    groups = contents.repartition(F.col("hash")).mapInArrow(run, "local long, keep_uid long, keep_id long, group_size long")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    if _whole(docs):
        kind = docs.schema["doc_id"].dataType
        members = found.filter("content IS NULL").select("doc_id", "uid", "local", "sha")
        return members.join(materialise(groups), "local").select(
            F.col("doc_id").cast(kind), F.col("keep_id").cast(kind), "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), sha)
    members = found.filter("content IS NULL").select("own", "uid", "local", "sha").join(
        groups.select("local", F.col("keep_uid").alias("group"), "group_size"), "local")
    return _least_own(materialise(members)).select(
        F.col("own").alias("doc_id"), F.col("least.own").alias("keep_id"), "group_size", (F.col("uid") == F.col("least.uid")).alias("kept"), sha)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""WITH N AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents),
G AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc_id NULLS LAST) = 1 AS kept FROM N)
SELECT doc_id, min(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, kept, sha256(plain) AS text_sha256 FROM G"""
