"""Aggregates over event records: A11-A13, A19-A22, A24, A25, A29, A30, and set operators U1-U6."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from obsline.functions.rules import FAMILIES, STRENGTHS, evidence_strength, normalize_outcome
from obsline.operators.joins import in_interval
from obsline.operators.scan import SEGMENT, scan
from obsline.operators.windows import STREAM


def reconcile_readings(readings: DataFrame, key: str = "observation_id") -> DataFrame:
    """Of an observation's readings the mode, with provenance.

    Empty and null readings are samples without a value. One sample is direct; agreeing ones are
    temporally_plausible; a tie, or one value among several samples, is rejected; none is inherited
    (column ``inherited``) or missing.
    """
    value = F.nullif(F.col("reading"), F.lit(""))
    by_value = readings.groupBy(key, value.alias("reading")).agg(F.count("*").alias("c"), F.first("inherited", ignorenulls=True).alias("inherited"))
    found = by_value.groupBy(key).agg(
        F.sum("c").alias("samples"), F.sum(F.when(F.col("reading").isNotNull(), F.col("c")).otherwise(0)).alias("observed"),
        F.count("reading").alias("kinds"), F.max(F.when(F.col("reading").isNotNull(), F.struct("c", "reading"))).alias("top"),
        F.collect_list(F.when(F.col("reading").isNotNull(), F.col("c"))).alias("counts"), F.first("inherited", ignorenulls=True).alias("inherited"))
    tied = F.size(F.filter("counts", lambda c: c == F.col("top.c"))) > 1
    provenance = (F.when((F.col("kinds") == 0) & F.col("inherited").isNotNull() & (F.col("inherited") != ""), "inherited").when(F.col("kinds") == 0, "missing")
                  .when((F.col("kinds") == 1) & (F.col("samples") == 1), "direct")
                  .when(~tied & (F.col("top.c") >= 2), "temporally_plausible").otherwise("rejected"))
    done = found.withColumn("provenance", provenance)
    return done.select(key, "samples", "observed", "provenance",
                       F.when(F.col("provenance") == "inherited", F.col("inherited")).when(F.col("provenance").isin("direct", "temporally_plausible"), F.col("top.reading")).alias("selected"))


def loss_and_accuracy(rows: DataFrame, depth: int = 16) -> DataFrame:
    """Mean capped loss, accuracy and rating estimate by side, from (stream_id, side, loss)."""
    low = max(0, 20 - depth)
    capped = F.least(F.greatest("loss", F.lit(0)), F.lit(1000))
    found = rows.filter("loss IS NOT NULL").groupBy(STREAM, "side").agg(F.count("*").alias("n"), F.avg(capped).alias("acpl"))
    rating = F.floor(3000 - low * 50 - F.col("acpl") * (10 + low * 0.5)).cast("int")
    return found.withColumn("accuracy", F.least(F.greatest(100 * F.exp(-0.007 * F.col("acpl")), F.lit(0.0)), F.lit(100.0))).withColumn(
        "rating", F.least(F.greatest(rating, F.lit(100)), F.lit(3000)))


def compact_observations(events: DataFrame, first: list[str], listed: list[str]) -> DataFrame:
    """One row for each observation: the first record's fields and the sorted list of its events.

    The key is the observation id, or the sequence where there is none.
    """
    key = F.coalesce("observation_id", F.col("sequence"))
    order = F.struct("sequence", "ts", "event")
    return events.groupBy(STREAM, key.alias("observation_key")).agg(
        *(F.min_by(c, order).alias(c) for c in first), F.array_sort(F.collect_list(F.struct("sequence", *listed))).alias("events"))


def temporal_support(rows: DataFrame, seconds: float = 0.75, each: float = 25, both: float = 70) -> DataFrame:
    """Samples, passes and maxima within the look-ahead; accepted with two of each."""
    from obsline.operators.joins import lookahead

    passed = (F.col("origin") >= each) & (F.col("target") >= each) & (F.col("origin") + F.col("target") >= both)
    found = lookahead(rows, seconds, {
        "samples": F.count("*"), "passes": F.count_if(passed), "most_origin": F.max("origin"), "most_target": F.max("target"),
        "most_pair": F.max(F.col("origin") + F.col("target"))})
    return found.withColumn("supported", (F.col("samples") >= 2) & (F.col("passes") >= 2))


def repeated_rejections(events: DataFrame) -> DataFrame:
    """By stream the rejections beyond the first of a candidate, and their reasons."""
    per = events.filter("outcome = 'rejected' AND candidate_id IS NOT NULL").groupBy(STREAM, "candidate_id").agg(
        F.count("*").alias("c"), F.collect_set("reason").alias("reasons")).filter("c > 1")
    return per.groupBy(STREAM).agg(F.count("*").alias("candidates"), F.sum(F.col("c") - 1).alias("repeated"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def run_counters(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Counters that a run fills in as it passes (``observation.get`` after an action)."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in counters.items())), seen


def detector_quality_report(events: DataFrame, *by: str) -> DataFrame:
    """Counts and summaries of a trace in one wide pass, by stream or other dimensions."""
    out = normalize_outcome(F.col("outcome"), F.col("event"))
    kinds = ["ACCEPT", "REJECT", "WAIT_FOR_SETTLE", "AMBIGUOUS", "RECOVERING", "OBSERVED", "INFORMATIONAL"]
    names = ["QUIET", "CANDIDATE", "ACCEPT", "VALIDATION_REJECTED", "SCORE_THRESHOLD_REJECTED", "REVERT_APPLIED", "COALESCED_STOP"]
    reasons = F.col("reason").isNotNull() & (F.col("reason") != "")
    return events.withColumn("normal", out).groupBy(*by).agg(
        F.count("*").alias("records"), F.count_distinct("candidate_id").alias("candidates"),
        *(F.count_if(F.col("normal") == k).alias(f"outcome_{k.lower()}") for k in kinds),
        *(F.count_if(F.col("event") == n).alias(f"event_{n.lower()}") for n in names),
        F.count_if(reasons).alias("with_reason"), F.count("score").alias("scored"), F.min("score").alias("score_min"),
        F.max("score").alias("score_max"), F.avg("score").alias("score_mean"), F.count_if(F.col("margin") < 10).alias("low_margin"),
        F.avg("margin").alias("margin_mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Flags, choices and numbers of a record's evidence that the quality report counts.
FLAGS = ("yellow_checked", "yellow_temporal_checked", "clock_checked", "clock_temporal_checked", "clock_ocr_skipped", "hover_checked", "hover_detected",
         "geometry_checked", "geometry_anomaly", "yellow_arrows_checked", "red_squares_checked")
CHOICES = ("mapper_emission_reason", "yellow_decision", "clock_decision", "clock_provenance", "clock_temporal_decision", "hover_decision", "geometry_decision",
           "rejection_reason", "template_identity", "yellow_assessment", "hover_assessment", "clock_assessment", "geometry_assessment")
LISTS = ("changed_squares", "yellow_candidates", "clock_candidates", "hover_measurements", "observation_tags", "yellow_arrows", "red_squares")
#: A number counts where its condition holds.
NUMBERS = {
    "changed_square_count": "true", "yellow_from": "yellow_checked", "yellow_to": "yellow_checked", "yellow_temporal_sample_count": "yellow_temporal_checked",
    "yellow_temporal_pair_pass_count": "yellow_temporal_checked", "yellow_temporal_max_from": "yellow_temporal_checked", "yellow_temporal_max_to": "yellow_temporal_checked",
    "yellow_temporal_max_pair": "yellow_temporal_checked", "clock_temporal_sample_count": "clock_temporal_checked", "clock_temporal_observed_count": "clock_temporal_checked",
    "clock_temporal_agreement_count": "clock_temporal_checked", "clock_top_bright_ratio": "clock_top_width > 0", "clock_bottom_bright_ratio": "clock_top_width > 0",
    "clock_bright_ratio_delta": "clock_top_width > 0", "strongest_edge": "hover_checked", "score_margin": "legal_candidates > 0", "localization_score": "localization_score >= 0",
    "localization_confidence": "localization_confidence BETWEEN 0 AND 1", "geometry_uncertainty": "true", "localization_scale": "localization_scale > 0",
    "geometry_drift": "geometry_checked", "geometry_relocalization_score": "geometry_relocalization_score >= 0",
}


def _fields(evidence: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in evidence.columns]


def quality_counters(evidence: DataFrame, *by: str, low: float = 10) -> DataFrame:
    """One wide pass over evidence fields (flat columns; those that a trace lacks are left out): records, set flags,
    records with lists and their entries, unavailable localisations and low margins."""
    size = {n: F.greatest(F.coalesce(F.size(n), F.lit(0)), F.lit(0)) for n in _fields(evidence, LISTS)}
    aggregates = [F.count("*").alias("records"), *(F.count_if(n).alias(n) for n in _fields(evidence, FLAGS)),
                  *(F.count_if(c > 0).alias(f"with_{n}") for n, c in size.items()), *(F.sum(c.cast("long")).alias(f"entries_{n}") for n, c in size.items())]
    if "localization_score" in evidence.columns:
        aggregates.append(F.count_if(F.col("localization_score") < 0).alias("localization_unavailable"))
    if {"score_margin", "legal_candidates"} <= set(evidence.columns):
        aggregates.append(F.count_if((F.col("legal_candidates") > 0) & (F.col("score_margin") < low)).alias("low_score_margin"))
    if "clock_top_width" in evidence.columns:
        aggregates.append(F.count_if(F.col("clock_top_width") > 0).alias("clock_regions_measured"))
    if "source_frame_index" in evidence.columns:
        aggregates.append(F.count_if(F.col("source_frame_index") > 0).alias("with_source_frame"))
    return evidence.groupBy(*by).agg(*aggregates)


def quality_choices(evidence: DataFrame, *by: str) -> DataFrame:
    """(field, value, n) of decisions, provenances, reasons, template identities and assessments that are given."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in _fields(evidence, CHOICES)))
    return evidence.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*").filter("value <> ''").groupBy(*by, "field", "value").agg(F.count("*").alias("n"))


def quality_numbers(evidence: DataFrame, *by: str) -> DataFrame:
    """(measure, n, least, most, mean) of numbers, each where its condition holds; rows without any value are left out."""
    def value(name: str, condition: str) -> Column:
        known = all(w in evidence.columns for w in re.findall(r"[a-z_]{4,}", condition) if w not in ("true",))
        return F.when(F.expr(condition) if known else F.lit(False), F.col(name).cast("double"))

    pairs = F.array(*(F.struct(F.lit(n).alias("measure"), value(n, c).alias("value")) for n, c in NUMBERS.items() if n in evidence.columns))
    tall = evidence.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*").filter("value IS NOT NULL AND NOT isnan(value)")
    return tall.groupBy(*by, "measure").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


def quality_rejections(events: DataFrame) -> DataFrame:
    """(rejected, candidates, repeated): rejections with a candidate, their candidates, and those beyond a candidate's first."""
    per = events.filter("event = 'VALIDATION_REJECTED' AND candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rejected"), F.count("*").alias("candidates"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))


def strength_rows(events: DataFrame) -> DataFrame:
    """Each record's five families in long form, from its ``evidence`` struct."""
    s = events.withColumn("strength", evidence_strength(F.col("evidence")))
    return s.withColumn("family", F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col("strength")[f].alias("state")) for f in FAMILIES))))


def strength_summary(events: DataFrame) -> DataFrame:
    """Counts by family and strength."""
    return strength_rows(events).select(F.col("family.name").alias("family"), F.col("family.state").alias("state")).groupBy("family").pivot("state", list(STRENGTHS)).count().na.fill(0)


def weak_acceptances(events: DataFrame) -> DataFrame:
    """Accepted records of which some family is not strong."""
    s = events.withColumn("strength", evidence_strength(F.col("evidence"))).withColumn("normal", normalize_outcome(F.col("outcome"), F.col("event")))
    return s.filter((F.col("normal") == "ACCEPT") & F.exists(F.array(*(F.col("strength")[f] for f in FAMILIES)), lambda x: x != "strong"))


def uncertainty_summary(events: DataFrame, *by: str) -> DataFrame:
    """Outcomes, and records with weak, missing and conflicting families."""
    s = events.withColumn("strength", evidence_strength(F.col("evidence"))).withColumn("normal", normalize_outcome(F.col("outcome"), F.col("event")))
    states = F.array(*(F.col("strength")[f] for f in FAMILIES))

    def some(state: str) -> Column:
        return F.count_if(F.exists(states, lambda x: x == state)).alias(f"{state}_records")

    return s.groupBy(*by).agg(F.count("*").alias("records"), F.count_if(F.col("normal") == "AMBIGUOUS").alias("ambiguous"),
                              F.count_if(F.col("normal") == "WAIT_FOR_SETTLE").alias("waiting"), some("weak"), some("missing"), some("conflicting"))


# The order of divergence rules, each a stage and a confidence.
STAGES = [("no_observation", "mapper", "high"), ("no_candidate", "scoring", "high"), ("rejected", "validation", "high"), ("below_threshold", "scoring", "medium"),
          ("rolled_back", "reducer", "medium"), ("deferred", "reducer", "low"), ("accepted_elsewhere", "reducer", "low")]


def diagnose_divergence(events: DataFrame, reports: DataFrame) -> DataFrame:
    """The likely stage of each report's divergence, from the events of its interval.

    reports: (report_id, stream_id, start, stop, move). The first rule that fits decides.
    """
    mine = F.col("e.best_move") == F.col("r.move")
    met = in_interval(events.select(STREAM, "ts", "event", "best_move"), reports.select("report_id", STREAM, "start", "stop")).select("report_id", "event", "best_move")
    joined = reports.alias("r").join(met.alias("e"), "report_id", "left")
    f = joined.groupBy("report_id").agg(
        F.count("e.event").alias("n"), F.count_if(mine).alias("candidates"), F.count_if(mine & (F.col("e.event") == "VALIDATION_REJECTED")).alias("rejected"),
        F.count_if(mine & (F.col("e.event") == "SCORE_THRESHOLD_REJECTED")).alias("below"), F.count_if(F.col("e.event") == "REVERT_APPLIED").alias("rolled"),
        F.count_if(F.col("e.event").startswith("SETTLE")).alias("deferred"), F.count_if(F.col("e.event") == "ACCEPT").alias("accepts"))
    tests = [F.col("n") == 0, F.col("candidates") == 0, F.col("rejected") > 0, F.col("below") > 0, F.col("rolled") > 0, F.col("deferred") > 0, F.col("accepts") > 0]
    rule = F.lit(None)
    for test, (cause, stage, sure) in reversed(list(zip(tests, STAGES, strict=True))):
        rule = F.when(test, F.struct(F.lit(cause).alias("cause"), F.lit(stage).alias("stage"), F.lit(sure).alias("confidence"))).otherwise(rule)
    return f.select("report_id", rule.alias("x")).select("report_id", F.coalesce("x.cause", F.lit("unknown")).alias("cause"),
                                                         F.coalesce("x.stage", F.lit("unknown")).alias("stage"), F.coalesce("x.confidence", F.lit("low")).alias("confidence"))


def expected_status(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Six-way status of each expected transition (stream_id, expected_id, move, start, stop)."""
    mine = F.coalesce(F.col("e.best_move") == F.col("x.move"), F.lit(False))
    met = in_interval(events.select(STREAM, "ts", "event", "outcome", "best_move"), expected.select("expected_id", STREAM, "start", "stop")).select("expected_id", "event", "outcome", "best_move")
    f = expected.alias("x").join(met.alias("e"), "expected_id", "left").groupBy("expected_id").agg(
        F.bool_or(mine & (F.col("e.outcome") == "accepted")).alias("accepted"), F.bool_or(mine & (F.col("e.outcome") == "rejected")).alias("rejected"),
        F.bool_or(mine & (F.col("e.outcome") == "deferred")).alias("deferred"), F.bool_or(mine).alias("seen"), F.count("e.event").alias("n"))
    status = (F.when(F.col("accepted"), "accepted").when(F.col("rejected"), "rejected").when(F.col("deferred"), "deferred")
              .when(F.col("seen"), "observed").when(F.col("n") > 0, "other_activity").otherwise("no_evidence"))
    return f.select("expected_id", status.alias("status"))


def durable_union(timeline: DataFrame, branches: DataFrame) -> DataFrame:
    """Main line and branches as one table of observations, with where each comes from."""
    return timeline.withColumn("origin", F.lit("main")).unionByName(branches.withColumn("origin", F.lit("branch")), allowMissingColumns=True)


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """Equal rows in equal numbers."""
    keys = a.columns
    n = a.select(*keys, F.lit(1).alias("__n")).unionAll(b.select(*keys, F.lit(-1).alias("__n"))).groupBy(*keys).agg(F.sum("__n").alias("__n"))
    return n.filter("__n <> 0").isEmpty()


def set_missing(required: DataFrame, observed: DataFrame) -> DataFrame:
    """U3."""
    return required.subtract(observed)


def distinct_states(timeline: DataFrame) -> DataFrame:
    """U4: states with the place where they were seen first."""
    return timeline.groupBy(STREAM, "state").agg(F.min("seq").alias("first_seq"))


def shared_ids(a: DataFrame, b: DataFrame, key: str = "observation_id") -> DataFrame:
    """U6."""
    return a.select(key).intersect(b.select(key))


def latest_rollback(rows: DataFrame) -> DataFrame:
    """ST7, batch form: what is left of a stream after its rollbacks (column target_seq where a row is one).

    A row survives if no later rollback goes to a place before it.
    """
    later = scan(rows, STREAM, ("seq",), least={"cut": F.col("target_seq")}, descending=True)
    return later.filter(F.col("target_seq").isNull() & (F.col("cut").isNull() | (F.col("seq") <= F.col("cut")))).drop("cut", SEGMENT)
