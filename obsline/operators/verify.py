"""Integrity checks V1-V8 and F30: each gives rows of findings; none means that all is well."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsline.functions.rules import RUN_LOCAL, canonical_record, event_layer
from obsline.functions.scalars import metadata_map, state_key
from obsline.operators.joins import compare_by_position, missing_artifacts
from obsline.operators.windows import ORDER, STREAM, duplicate_accepts, known_before, monotonic_check, mutation_check

FINDING = "stream_id, finding, detail"


def finding(df: DataFrame, name: str, detail: Column) -> DataFrame:
    return df.select(STREAM, F.lit(name).alias("finding"), detail.cast("string").alias("detail"))


def timeline_invariants(timeline: DataFrame, states: DataFrame, branches: DataFrame) -> DataFrame:
    """V1: a stream has one state more than transitions, times do not fall, a reading that is missing has no
    text, branches start inside the main line, and at a state equal to their root or inside another branch."""
    n = timeline.groupBy(STREAM).agg(F.count("*").alias("n"))
    m = states.groupBy(STREAM).agg(F.count("*").alias("m"))
    counts = n.join(m, STREAM, "full_outer").filter(F.coalesce("m", F.lit(0)) != F.coalesce("n", F.lit(0)) + 1)
    falls = monotonic_check(timeline, "ts", "seq")
    contradiction = timeline.filter((F.col("provenance") == "missing") & F.col("reading").isNotNull() | (F.col("provenance") == "direct") & F.col("reading").isNull())
    top = branches.groupBy(STREAM, "branch_id").agg(F.min("parent_seq").alias("parent_seq"), F.min_by("state", "step").alias("root"))
    ends = states.groupBy(STREAM).agg(F.max("seq").alias("last"))
    outside = top.join(ends, STREAM, "left").filter((F.col("parent_seq") < 0) | (F.col("parent_seq") > F.coalesce("last", F.lit(-1))))
    parents = states.select(STREAM, F.col("seq").alias("parent_seq"), state_key(F.col("state")).alias("at"))
    off = top.join(parents, [STREAM, "parent_seq"], "left").filter(~F.coalesce(state_key(F.col("root")) == F.col("at"), F.lit(False))).select(STREAM, "branch_id", state_key(F.col("root")).alias("key"))
    inside = branches.filter("step > 0").select(STREAM, F.col("branch_id").alias("other"), state_key(F.col("state")).alias("key"))
    nested = off.join(inside, [STREAM, "key"]).filter(F.col("other") != F.col("branch_id")).select(STREAM, "branch_id").distinct()
    moved = off.join(nested, [STREAM, "branch_id"], "left_anti")
    return (finding(counts, "count", F.concat_ws("/", "n", "m")).unionByName(finding(falls, "time_falls", F.col("seq")))
            .unionByName(finding(contradiction, "provenance", F.col("seq"))).unionByName(finding(outside, "parent_outside", F.col("branch_id")))
            .unionByName(finding(moved, "root_differs", F.col("branch_id"))))


def trace_invariants(events: DataFrame) -> DataFrame:
    """V2: repeated accepts, rollbacks to unknown states, rejected rows that change a state."""
    accepts = duplicate_accepts(events.filter("event = 'ACCEPT'"))
    unknown = known_before(events.withColumn("rollback", F.col("event") == "REVERT_APPLIED"))
    mutated = mutation_check(events)
    return (accepts.select(STREAM, "finding", F.col("observation_id").cast("string").alias("detail"))
            .unionByName(finding(unknown, "unknown_rollback_target", F.col("observation_id"))).unionByName(finding(mutated, "rejected_mutation", F.col("observation_id"))))


def observation_contract(obs: DataFrame, listing: DataFrame | None = None, artifacts: list[str] = (), pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """V3: ids that repeat, order that falls, artifacts that are missing or lack their pair."""
    again = obs.groupBy(STREAM, "observation_id").agg(F.count("*").alias("n")).filter("n > 1")
    falls = monotonic_check(obs, "ts", "sequence")
    found = finding(again, "duplicate_id", F.col("observation_id")).unionByName(finding(falls, "not_monotonic", F.col("observation_id")))
    if listing is None:
        return found
    gone = missing_artifacts(obs, listing, list(artifacts), list(pairs))
    return found.unionByName(gone.join(obs.select(STREAM, "observation_id").distinct(), "observation_id").select(
        STREAM, "finding", F.concat_ws(":", F.col("observation_id").cast("string"), "artifact").alias("detail")))


def summary_contract(summary: DataFrame, required: list[str], statuses: tuple[str, ...]) -> DataFrame:
    """V4: required fields, unique ids, known statuses, intervals in order."""
    lack = summary.filter(F.exists(F.array(*(F.col(c).cast("string") for c in required)), lambda x: x.isNull()))
    again = summary.groupBy(STREAM, "summary_id").agg(F.count("*").alias("n")).filter("n > 1")
    odd = summary.filter(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)))
    turned = summary.filter(F.col("stop") < F.col("start"))
    return (finding(lack, "required_field", F.col("summary_id")).unionByName(finding(again, "duplicate_summary", F.col("summary_id")))
            .unionByName(finding(odd, "unknown_status", F.col("summary_id"))).unionByName(finding(turned, "interval", F.col("summary_id"))))


def first_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """the least path at which two records (keys, fields map) differ, with both values."""
    e = expected.select(*keys, F.explode("fields").alias("path", "expected"))
    a = actual.select(*keys, F.explode("fields").alias("path", "actual"))
    off = e.join(a, [*keys, "path"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    return off.groupBy(*keys).agg(F.min_by(F.struct("path", "expected", "actual"), "path").alias("x")).select(*keys, "x.*")


def compare_runs(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """V5: exact comparison of records without run-local keys: the first path that differs in each."""
    def plain(df: DataFrame) -> DataFrame:
        return df.withColumn("fields", canonical_record(F.col("fields")))

    return first_difference(plain(expected), plain(actual), keys)


#: Types of JSON values by the names that Spark gives them; a number without a fraction is an integer.
JSON_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DOUBLE": "number"}
PLACE = "array<struct<at:int,key:string>>"


def json_nodes(records: DataFrame, keys: list[str], record: str, local: tuple[str, ...] = ()) -> DataFrame:
    """(keys, place, path, kind, value): every node of a JSON text, the whole first, without object keys in ``local`` at any depth.

    Arrays are entered by position, ``path`` is written as $.a.b[0], ``place`` sorts as a walk that takes keys in order. ``value`` is the node as
    JSON text, numbers as their shortest form. A text that is no JSON is one node of kind malformed. One pass a level of nesting, each
    written to the checkpoint folder.
    """
    spark = records.sparkSession
    value = F.try_parse_json(record)
    level = records.filter(F.col(record).isNotNull()).select(
        *keys, F.array().cast(PLACE).alias("place"), F.lit("$").alias("path"), value.alias("v"), F.when(value.isNull(), F.col(record)).alias("raw"))
    out = None
    while True:
        name = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        whole = F.schema_of_variant("v").rlike(r"^DECIMAL\(\d+,0\)")
        kind = F.when(F.col("v").isNull(), "malformed").when(whole, "integer").otherwise(
            F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in JSON_KINDS.items() for x in pair]), name), F.lit("number")))
        told = F.when(kind == "number", F.try_variant_get("v", "$", "double").cast("string")).otherwise(F.to_json("v"))
        nodes = level.withColumn("kind", kind)
        found = nodes.select(*keys, "place", "path", "kind", F.coalesce(told, "raw").alias("value"))
        out = found if out is None else out.unionByName(found)
        nested = nodes.filter("kind IN ('object', 'array')").withColumnRenamed("v", "whole")
        inner = nested.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        step = F.struct(F.when(F.col("key").isNull(), F.col("pos")).cast("int").alias("at"), "key")
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.filter(F.col("key").isNull() | ~F.col("key").isin(*local)).select(
            *keys, F.concat("place", F.array(step)).alias("place"), F.concat("path", name).alias("path"), F.col("value").alias("v"), F.lit(None).cast("string").alias("raw")).checkpoint()
        if level.isEmpty():
            return out


def differing_texts(expected: DataFrame, actual: DataFrame, keys: list[str], record: str, local: tuple[str, ...] = ()) -> DataFrame:
    """(keys, _e, _a): pairs of texts that may differ, so that the others need no walk.

    Left out are equal texts, and sound ones that are equal but for values of ``local`` that are plain strings: between two quotes, of which the first
    is followed by a colon, no sound JSON has anything but a key. What is spelled otherwise stays.
    """
    both = expected.select(*keys, F.col(record).alias("_e")).join(actual.select(*keys, F.col(record).alias("_a")), keys, "full_outer")
    same = F.col("_e").eqNullSafe(F.col("_a"))
    if local:
        bare = [F.regexp_replace(c, F.lit('"(?:' + "|".join(map(re.escape, local)) + r')":"[^"\\]*"'), F.lit('""')) for c in ("_e", "_a")]
        sound = F.try_parse_json("_e").isNotNull() & F.try_parse_json("_a").isNotNull()
        same = same | F.coalesce((bare[0] == bare[1]) & sound, F.lit(False))
    return both.filter(~same)


def first_json_difference(expected: DataFrame, actual: DataFrame, keys: list[str], record: str = "record", local: tuple[str, ...] = ()) -> DataFrame:
    """F30 for nested records: the first path at which two JSON texts differ, with kinds and values of both sides.

    Objects are walked by key, arrays by position, a node before what is inside it. Values of different kinds differ, 1 and 1.0 too. A path that
    one side lacks has no kind there, which tells it from a null; so has a record that one side lacks, or that is null there. Keys are not null.
    """
    off = differing_texts(expected, actual, keys, record, local).checkpoint()
    sides = [off.filter(F.col(side).isNotNull()).select(*keys, F.lit(side).alias("_side"), F.col(side).alias(record)) for side in ("_e", "_a")]
    nodes = json_nodes(sides[0].unionByName(sides[1]), [*keys, "_side"], record, local)  # both sides at once, a level of both to a pass
    e, a = (nodes.filter(F.col("_side") == side).drop("_side") for side in ("_e", "_a"))
    e = e.withColumnsRenamed({"kind": "expected_kind", "value": "expected"})
    a = a.withColumnsRenamed({"kind": "actual_kind", "value": "actual", "path": "a_path"})
    leaf = ~F.coalesce(F.col("expected_kind").isin("object", "array"), F.lit(False))
    both = e.join(a, [*keys, "place"], "full_outer")
    off = both.filter(~F.col("expected_kind").eqNullSafe(F.col("actual_kind")) | (leaf & ~F.col("expected").eqNullSafe(F.col("actual"))))
    found = F.struct(F.coalesce("path", "a_path").alias("path"), "expected_kind", "actual_kind", "expected", "actual")
    return off.groupBy(*keys).agg(F.min_by(found, "place").alias("x")).select(*keys, "x.*")


def compare_json_runs(expected: DataFrame, actual: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """V5 for nested records: the first path that differs in each, run-local keys left out at any depth."""
    return first_json_difference(expected, actual, keys, record, RUN_LOCAL)


def compare_mapping_runs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """V6: position by position the first layer that differs: emission, evidence, scoring, then state."""
    w = Window.partitionBy(STREAM).orderBy(*ORDER)
    cols = ["emission", "evidence_key", "scoring", "state"]

    def ranked(df: DataFrame, p: str) -> DataFrame:
        return df.select(STREAM, (F.row_number().over(w) - 1).alias("position"), F.lit(1).alias(f"{p}_there"), *(F.col(c).alias(f"{p}_{c}") for c in cols))

    both = ranked(expected, "e").join(ranked(actual, "a"), [STREAM, "position"], "full_outer")
    layer = F.when(F.col("e_there").isNull() | F.col("a_there").isNull(), "emission")
    for c, name in zip(cols, ["emission", "evidence", "scoring", "state"], strict=True):
        layer = layer.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), name)
    return both.select(STREAM, "position", layer.alias("layer")).filter("layer IS NOT NULL")


# What a semantic comparison looks at, family by family.
SEMANTIC = {"accepted": "event = 'ACCEPT'", "readings": "event LIKE 'CLOCK\\_%'", "recovery": "event LIKE 'REVERT%' OR event LIKE 'HANDOFF%'", "branches": "event LIKE 'VARIATION%'"}
VOLATILE = ("ts", "elapsed", "candidate_id", "observation_id")


def compare_semantics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """V7: the first mismatch of each family, with the layer it speaks for; metadata without volatile keys."""
    def key(df: DataFrame) -> DataFrame:
        meta = F.array_sort(F.map_entries(metadata_map(F.coalesce("metadata", F.lit("")), VOLATILE)))
        return df.withColumn("semantic", F.concat_ws("|", "event", "state", "move", F.to_json(meta)))

    e, a, out = key(expected), key(actual), None
    for family, test in SEMANTIC.items():
        rows = compare_by_position(e.filter(test), a.filter(test), "semantic", first_only=True).withColumn("family", F.lit(family))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("layer", event_layer(F.substring_index(F.coalesce("expected", "actual"), "|", 1)))


def evidence_window(reports: DataFrame, pad: float = 1.0, least: float = 0.5) -> DataFrame:
    """V8: the padded interval of a report, at least ``least`` long; null unless it is narrower than the run."""
    a, b = F.greatest(F.col("start") - pad, F.col("run_start")), F.least(F.col("stop") + pad, F.col("run_stop"))
    wide = F.greatest(b, a + least)
    narrower = (wide - a) < (F.col("run_stop") - F.col("run_start"))
    return reports.withColumn("window_start", F.when(narrower, a)).withColumn("window_stop", F.when(narrower, wide))


def divergence_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """By stream the first mismatch of two move sequences, its kind, and the last agreed time before it."""
    first = compare_by_position(expected, actual, "move", first_only=True)
    w = Window.partitionBy(STREAM).orderBy(*ORDER)
    times = expected.select(STREAM, F.row_number().over(w).alias("position"), F.col("ts").alias("anchor_ts"))  # the place before
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("different")
    return first.join(times, [STREAM, "position"], "left").withColumn("kind", kind)


