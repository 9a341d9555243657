"""Merkle manifest of a data set by butterfly exchange (operator 11).

Rows become leaves: digests of their columns. The leaves of a group ascend by id; each run of ``fanout`` nodes
becomes one, until one is left, the group's root; the groups' roots, in order, become the root likewise.

Leaves are sorted by range, numbered by prefix sums over the ranges, and cut into blocks of fanout ** ``levels``. A
block makes its own tree. Then blocks exchange roots as in a butterfly network: in round r, block b swaps with
the blocks whose number differs from b's in digit r alone (to the base of the fanout), so the blocks of an aligned group
hold the same nodes afterwards, and each hashes them into their common ancestor. A block therefore has its
whole path when the rounds are over, and nothing is handed down. A group's blocks are filled up to a power
of the fanout by blocks without leaves, which pass on what they have received, so that each block sends exactly
``fanout`` messages and gets as many. The groups' roots go through the same rounds, one row a group.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsline.llm.common import materialise

FANOUT = 8
#: Levels of the tree that one block makes: 4096 leaves.
LEVELS = 4
#: Blocks of a group that read one copy of the group's path.
SHARE = 1024
PATH = "array<struct<place:int,others:array<string>>>"
PATH_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(columns: list[Column]) -> Column:
    """Digest of the columns in turn: ``-`` for null, else the length in bytes, ``:`` and the value as text."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def node(digests: Column) -> Column:
    """Digest of an array of digests."""
    return F.sha2(F.concat_ws("", digests), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(
        F.concat_ws("", F.slice(step["others"], 1, step["place"])), at,
        F.concat_ws("", F.slice(step["others"], step["place"] + 1, F.lit(1 << 20)))), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up, left to right."""
    return node(F.flatten(F.transform(path, lambda step: step["others"])))


def height(count: Column, fanout: int) -> Column:
    """Levels above ``count`` nodes: the least k with fanout ** k at least the count."""
    return reduce(lambda rest, k: F.when(count > fanout ** (k - 1), k).otherwise(rest), (k for k in range(1, 64) if fanout ** (k - 1) < 1 << 62), F.lit(0))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with ``at``, their number (from 0) in the order of their group, and ``n``, the rows of the group.

    Sorting is by ranges of all rows, so a large group lies in many tasks. The numbers of rows before each range are
    sums over one row for each (group, range). Rows that are equal in all of ``order`` are spread by their place in the table.
    """
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(group), *order, F.col("_tie")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        spread.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_in")))
    ranges = placed.groupBy(group, "_range").agg(F.count("*").alias("_rows"), F.min("_in").alias("_first"))
    whole = Window.partitionBy(group)
    ranges = ranges.withColumns({
        "_before": F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("_rows").over(whole)})
    return placed.join(ranges, [group, "_range"]).select(
        *rows.columns, (F.col("_in") - F.col("_first") + F.coalesce("_before", F.lit(0))).alias("at"), "n")


def butterfly(held: DataFrame, group: str, fanout: int, rounds: int) -> DataFrame:
    """(group, block, root, path): each block's path to the root of its group, and that root.

    ``held`` is (group, block, root, height, count): blocks numbered from 0 in each group, the digest that each
    starts from, how many rounds the group takes and how many blocks it has.
    """
    nothing = F.array().cast(PATH)
    # Blocks without leaves, up to a power of the fanout: each block stands for those whose numbers differ by a multiple of the count.
    more = held.withColumn("block", F.explode(F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda k: F.col("block") + k * F.col("count"))))
    empty = more.filter(F.col("block") < F.pow(F.lit(fanout), F.col("height")).cast("long")).withColumn("root", F.lit(None).cast("string"))
    state = held.unionByName(empty).withColumn("path", nothing)
    for r in range(rounds):
        stride = fanout**r
        swaps = F.col("height") > r
        own = F.expr(f"CAST(pmod(block DIV {stride}, {fanout}) AS INT)")
        sent = (
            state.filter(swaps).withColumn("_own", own).withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
            .select(group, "height", "count", (F.col("block") + (F.col("_to") - F.col("_own")) * F.lit(stride)).alias("block"), F.struct("_own", "root").alias("_sent"),
                    F.when(F.col("_to") == F.col("_own"), F.col("path")).alias("path"), F.when(F.col("_to") == F.col("_own"), F.col("_own")).alias("_own")))
        met = sent.groupBy(group, "height", "count", "block").agg(
            F.array_sort(F.collect_list("_sent")).alias("_all"), F.first("path", ignorenulls=True).alias("path"), F.max("_own").alias("_own"))
        there = F.filter("_all", lambda m: m["root"].isNotNull())
        others = F.transform(F.filter(there, lambda m: m["_own"] != F.col("_own")), lambda m: m["root"])
        place = F.size(F.filter(there, lambda m: m["_own"] < F.col("_own")))
        swapped = met.select(
            group, "block", F.when(F.size(there) > 0, node(F.transform(there, lambda m: m["root"]))).alias("root"), "height", "count",
            F.concat("path", F.array(F.struct(place.alias("place"), others.alias("others")))).alias("path"))
        state = swapped.unionByName(state.filter(~swaps))
    return state.filter("block < count").select(group, "block", "root", "path")


def _climb(digests: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes of each level, from the leaves up."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _top(table: DataFrame, column: str) -> int:
    return table.agg(F.max(column)).first()[0] or 0


def manifest(leaves: DataFrame, ident: str, group: str, digest: str, carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Of each leaf: ``ident``, ``group``, ``digest``, the columns of ``carry``, subroot, root and path.

    ``path`` lists, level by level from the leaf up to the root, the siblings in the leaf's run (left to
    right) and how many of them stand before it. Leaves ascend by ``ident`` (null first), then by digest; equal leaves
    are interchangeable. Groups ascend bytewise (null first). A group of one leaf has that leaf as its root,
    and one group's root is the root. No rows give an empty result.

    Leaves, blocks and groups are tables of the shared folder; the driver learns how many rounds there are.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first
    told = F.struct(F.col(ident).alias(ident), F.col(group).alias(group), *[F.col(c).alias(c) for c in carry])
    plain = materialise(leaves.select(key.alias("_group"), F.col(ident).alias("_id"), F.col(digest).alias("_leaf"), told.alias("_told")))
    size = fanout**levels
    placed = numbered(plain, "_group", [F.col("_id"), F.col("_leaf")]).select(
        "_group", F.expr(f"at DIV {size}").alias("block"), F.expr(f"CAST(at % {size} AS INT)").alias("_place"), "_leaf", "_told", "n")

    def tree(rows: pa.Table) -> list[list[str]]:
        n = rows["n"][0].as_py()
        most = next(k for k in range(levels + 1) if k == levels or fanout**k >= n)
        return _climb(rows["_leaf"].to_pylist(), fanout, most)

    def roots(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        return pa.table({**{c: rows[c].slice(0, 1) for c in ("_group", "block", "n")}, "root": [tree(rows)[-1][0]]})

    tops = placed.drop("_told").groupBy("_group", "block").applyInArrow(roots, "_group string, block long, n long, root string")
    blocks = materialise(tops.select(
        "_group", "block", "root", F.greatest(height(F.col("n"), fanout) - levels, F.lit(0)).alias("height"), F.ceil(F.col("n") / size).alias("count")))
    paths = materialise(butterfly(blocks, "_group", fanout, _top(blocks, "height")))
    # The groups' roots: one row a group, as blocks of a single group.
    firsts = paths.filter("block = 0").select("_group", "root", F.lit(0).alias("_top"))
    groups = materialise(numbered(firsts, "_top", [F.col("_group")]).select(
        "_top", F.col("at").alias("block"), "root", height(F.col("n"), fanout).alias("height"), F.col("n").alias("count"), "_group"))
    above = butterfly(groups.drop("_group"), "_top", fanout, _top(groups, "height")).select("block", F.col("root").alias("_root"), F.col("path").alias("_above"))
    upper = groups.select("_group", "block", F.col("root").alias("subroot")).join(above, "block").drop("block")
    upper = upper.join(blocks.filter("block = 0").select("_group", "count"), "_group").select(
        "_group", "subroot", "_root", "_above", F.explode(F.sequence(F.lit(0), F.expr(f"(count - 1) DIV {SHARE}"))).alias("_share"))
    whole = paths.withColumn("_share", F.expr(f"block DIV {SHARE}")).join(upper, ["_group", "_share"]).select(
        "_group", "block", "subroot", F.col("_root").alias("root"), F.concat("path", "_above").alias("path"))

    def proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        nodes, rest = tree(rows)[:-1], above["path"][0].as_py()
        found = []
        for at in range(len(rows)):
            path = []
            for level in nodes:
                start = at - at % fanout
                path.append({"place": at - start, "others": level[start:at] + level[at + 1 : start + fanout]})
                at //= fanout
            found.append(path + rest)
        same = {c: pa.chunked_array([pa.repeat(above[c][0], len(rows))]) for c in ("subroot", "root")}
        return pa.table({"_told": rows["_told"], "leaf": rows["_leaf"], **same, "path": pa.array(found, PATH_ARROW)})

    kind = placed.schema["_told"].dataType.simpleString()
    out = placed.groupBy("_group", "block").cogroup(whole.groupBy("_group", "block")).applyInArrow(
        proofs, f"_told {kind}, leaf string, subroot string, root string, path {PATH}")
    return out.select("_told.*", "leaf", "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "lang", leaf([*row, F.col("text")]).alias("leaf"), leaf([*row, tampered]).alias("tampered"))
    found = manifest(leaves, "doc_id", "lang", "leaf", carry=("tampered",))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("tampered"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 7, tops: int = 2) -> str:
    """SQL for trees of up to 8 ** levels leaves a group and 8 ** tops groups."""
    def told(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name: str, most: int, group: str) -> list[str]:
        steps = []
        for k in range(most):
            steps.append(f"""{name}{k}s AS (SELECT *, count(*) OVER (PARTITION BY {group}) > 1 AS more,
  coalesce(string_agg(d, '') OVER (PARTITION BY {group}, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS left_,
  coalesce(string_agg(d, '') OVER (PARTITION BY {group}, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS right_ FROM {name}{k})""")
            steps.append(f"""{name}{k + 1} AS (SELECT {group}, pos // 8 AS pos, CASE WHEN bool_or(more) THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d
  FROM {name}{k}s GROUP BY {group}, pos // 8)""")
        return steps

    steps = [
        """crc AS (SELECT doc_id AS crc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
  lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
        f"""rows_ AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {told("text")} AS leaf,
  {told(f"(CASE WHEN crc % 3 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END)")} AS tampered
  FROM documents LEFT JOIN crc ON doc_id = crc_id)""",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_)",
        "l0 AS (SELECT g, pos, leaf AS d FROM leaves)", *climb("l", levels, "g"),
        f"t0 AS (SELECT 0 AS a, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, d, g FROM l{levels})", *climb("t", tops, "a")]
    joins, fold_, proof = "", "tampered", []
    for name, most, place in (("l", levels, "leaves.pos"), ("t", tops, "t0.pos")):
        for k in range(most):
            side = f"{name}{k}n"
            on = f"{side}.g = leaves.g AND " if name == "l" else ""
            joins += f" JOIN {name}{k}s AS {side} ON {on}{side}.pos = {place} // {8**k}"
            proof.append(f"CASE WHEN {side}.more THEN {side}.left_ || {side}.right_ ELSE '' END")
        if name == "l":
            joins += " JOIN t0 ON t0.g = leaves.g"
    inner = "SELECT doc_id, leaf, t0.d AS subroot, top.d AS root, sha256(" + " || ".join(proof) + ") AS proof_sha256, tampered AS f0"
    sides = [f"{name}{k}n" for name, most in (("l", levels), ("t", tops)) for k in range(most)]
    inner += "".join(f", {s}.more AS m{i}, {s}.left_ AS a{i}, {s}.right_ AS b{i}" for i, s in enumerate(sides))
    inner += f" FROM leaves{joins} CROSS JOIN (SELECT d FROM t{tops}) AS top"
    steps.append(f"p0 AS ({inner})")
    for i in range(len(sides)):
        steps.append(f"p{i + 1} AS (SELECT * EXCLUDE (f{i}, m{i}, a{i}, b{i}), CASE WHEN m{i} THEN sha256(a{i} || f{i} || b{i}) ELSE f{i} END AS f{i + 1} FROM p{i})")
    n = len(sides)
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, f{n} AS folded_root, f{n} = root AS verified FROM p{n}"


OP11_SQL = _sql()
