"""Row rules P8-P22 of the inventory: classifications, gates and records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event vocabulary: event name or prefix (with *) to phase, outcome, reason; the first that fits.
EVENT_RULES = [
    ("QUIET", "detector", "observed", "quiet_frame"),
    ("CANDIDATE", "scoring", "observed", "candidate_observed"),
    ("ACCEPT", "reducer", "accepted", "move_accepted"),
    ("VALIDATION_REJECTED", "validation", "rejected", "validation_rejected"),
    ("REJECTED_FRAME", "validation", "rejected", "frame_rejected"),
    ("SCORE_THRESHOLD_REJECTED", "scoring", "rejected", "score_threshold"),
    ("SETTLE_PROBE", "reducer", "deferred", "candidate_held_for_settling"),
    ("SETTLE_RETARGET", "reducer", "deferred", "candidate_held_for_settling"),
    ("MOVE_OVERRIDE", "reducer", "observed", "move_override"),
    ("HOVER_MEASURE", "validation", "observed", "hover_measured"),
    ("ORIGIN_CANDIDATE", "scoring", "ambiguous", "candidate_ambiguous"),
    ("COALESCED_STOP", "mapper", "deferred", "frame_coalesced"),
    ("CLOCK_*", "clock", "observed", "clock_observation"),
    ("REVERT_SEARCH", "revert", "observed", "revert_search"),
    ("REVERT_NEAREST", "revert", "observed", "revert_search"),
    ("HISTORICAL*", "revert", "observed", "revert_search"),
    ("REVERT_APPLIED", "revert", "recovered", "revert_applied"),
    ("PRESERVED_MAINLINE_RESTORED", "revert", "recovered", "revert_applied"),
    ("REPEATED_BRANCH_HANDOFF", "revert", "recovered", "revert_applied"),
    ("HANDOFF_RESULT", "revert", "recovered", "revert_applied"),
    ("REBASED_CONTINUATION", "revert", "recovered", "revert_applied"),
    ("HANDOFF_*", "reducer", "observed", "state_handoff"),
    ("REBASE_*", "reducer", "observed", "state_handoff"),
    ("VARIATION*", "reducer", "recovered", "variation_update"),
    ("FINAL_VARIATION", "reducer", "recovered", "variation_update"),
]
# Explicit outcomes, and what events stand for without one.
OUTCOMES = {"accepted": "ACCEPT", "rejected": "REJECT", "deferred": "WAIT_FOR_SETTLE", "ambiguous": "AMBIGUOUS", "recovered": "RECOVERING"}
EVENT_OUTCOMES = [
    ("ACCEPT", "ACCEPT"), ("QUIET", "INFORMATIONAL"),
    ("VALIDATION_REJECTED", "REJECT"), ("REJECTED_FRAME", "REJECT"), ("SCORE_THRESHOLD_REJECTED", "REJECT"),
    ("SETTLE_PROBE", "WAIT_FOR_SETTLE"), ("SETTLE_RETARGET", "WAIT_FOR_SETTLE"), ("COALESCED_STOP", "WAIT_FOR_SETTLE"),
    ("MOVE_OVERRIDE", "OBSERVED"), ("HOVER_MEASURE", "OBSERVED"), ("ORIGIN_CANDIDATE", "AMBIGUOUS"),
    ("REVERT*", "RECOVERING"), ("REBASE*", "RECOVERING"), ("HANDOFF*", "RECOVERING"), ("HISTORICAL*", "RECOVERING"),
    ("PRESERVED_MAINLINE_RESTORED", "RECOVERING"),
]
STRENGTHS = ("strong", "weak", "advisory", "missing", "conflicting")
FAMILIES = ("board_difference", "highlights", "clocks", "temporal_stability", "hover_state")
POSITIVE = ("positive", "pos", "true", "1", "yes", "detected", "passed")
NEGATIVE = ("negative", "neg", "false", "0", "no", "clear", "missing")
# Run-local keys, which differ between equal runs.
RUN_LOCAL = ("diagnostic_frame_path", "diagnostic_board_path", "diagnostic_predecessor_board_path",
             "diagnostic_clock_top_path", "diagnostic_clock_bottom_path")


def _fits(event: Column, name: str) -> Column:
    return event.startswith(name[:-1]) if name.endswith("*") else event == name


def classify_event(event: Column) -> Column:
    """Struct (phase, outcome, reason); other names are informational, empty ones null."""
    def row(phase: str, outcome: str, reason: str) -> Column:
        return F.struct(F.lit(phase).alias("phase"), F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))

    rule = F.when(event.isNull() | (event == ""), F.lit(None))
    for name, *what in EVENT_RULES:
        rule = rule.when(_fits(event, name), row(*what))
    return rule.otherwise(row("reducer", "informational", "legacy_event"))


def normalize_outcome(outcome: Column, event: Column) -> Column:
    """An explicit outcome first, else the event's."""
    given, name = F.lower(F.trim(outcome)), F.upper(F.coalesce(event, F.lit("")))
    rule = F.when(given == next(iter(OUTCOMES)), OUTCOMES[next(iter(OUTCOMES))])
    for key, value in list(OUTCOMES.items())[1:]:
        rule = rule.when(given == key, value)
    for key, value in EVENT_OUTCOMES:
        rule = rule.when(_fits(name, key), value)
    return rule.when(name != "", "OBSERVED").otherwise("INFORMATIONAL")


def _family(explicit: Column, checked: Column, decision: Column, conflicting: tuple, missing: tuple, strong: tuple, weak: tuple = ()) -> Column:
    said, given = F.coalesce(F.lower(decision), F.lit("")), F.lower(explicit)
    return (F.when(given.isin(*STRENGTHS), given)
            .when(~F.coalesce(checked, F.lit(False)) & (said == ""), "missing")
            .when(said.isin(*conflicting), "conflicting").when(said.isin(*missing) if missing else F.lit(False), "missing")
            .when(said.isin(*weak) if weak else F.lit(False), "weak").when(said.isin(*strong), "strong").otherwise("weak"))


def evidence_strength(e: Column) -> Column:
    """P10: a struct of five families, each strong, weak, advisory, missing or conflicting.

    ``e`` is a struct with changed_square_count, changed_squares, and for yellow, clock and hover
    <name>_checked, <name>_decision and <name>_strength, with yellow_temporal_checked and settle_decision.
    """
    listed = F.coalesce(F.size(e["changed_squares"]), F.lit(0))
    count = F.coalesce(e["changed_square_count"], listed)
    board = F.when(e["changed_square_count"].isNull() & (listed <= 0), "missing").when((count == 2) & (listed > 0), "strong").otherwise("weak")
    settled, timed = F.coalesce(F.lower(e["settle_decision"]), F.lit("")), F.coalesce(e["yellow_temporal_checked"], F.lit(False))
    stable = (F.when(~timed & (settled == ""), "missing").when(settled.isin("ambiguous", "conflicting", "rejected_unrelated_motion"), "conflicting")
              .when(settled.isin("accepted_same_move", "accepted_new_move", "stable", "passed"), "strong").otherwise("weak"))
    yellow = _family(e["yellow_strength"], e["yellow_checked"], e["yellow_decision"], ("ambiguous", "conflicting"),
                     ("no_highlight", "missing", "ocr_missing"), ("passed", "accepted", "strong"))
    clock = _family(e["clock_strength"], e["clock_checked"], e["clock_decision"], ("ambiguous", "conflicting", "turn_mismatch"),
                    ("ocr_missing", "missing"), ("ocr_plausible", "passed", "accepted", "turn_match"))
    hover = _family(e["hover_strength"], e["hover_checked"], e["hover_decision"], ("ambiguous", "conflicting"), (),
                    ("clear", "passed", "accepted"), ("detected", "detected_but_overridden"))
    return F.struct(board.alias("board_difference"), yellow.alias("highlights"), clock.alias("clocks"),
                    stable.alias("temporal_stability"), hover.alias("hover_state"))


def normalize_label(c: Column) -> Column:
    """Positive, negative or uncertain."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*POSITIVE), "positive").when(text.isin(*NEGATIVE), "negative").otherwise("uncertain")


def highlight_gate(origin: Column, target: Column, each: float = 25, both: float = 70) -> Column:
    """Passed, absent (both ends below the least) or ambiguous."""
    return F.when((origin >= each) & (target >= each) & (origin + target >= both), "passed").when(
        (origin < each) & (target < each), "absent").otherwise("ambiguous")


def strong_registration(score: Column, origin: Column, target: Column, kind: str = "hover") -> Column:
    """Whether a registration is strong enough to override a hover or a clock veto."""
    least, end, pair = {"hover": (60, 40, 90), "clock": (100, 35, 100)}[kind]
    return (score >= least) & (origin >= end) & (target >= end) & (origin + target >= pair)


def changed_cells(a: Column, b: Column, least: float = 15) -> Column:
    """Positions (from 0) whose values differ by ``least`` or more."""
    flagged = F.transform(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d, i: F.when(d >= least, i))
    return F.array_compact(flagged)


def quiet_filter(a: Column, b: Column, least: float = 15) -> Column:
    """No cell differs by ``least`` or more."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) < least


def canonical_record(fields: Column, local: tuple[str, ...] = RUN_LOCAL) -> Column:
    """A map of flattened fields without run-local keys at any depth (``a.b.key``)."""
    return F.map_filter(fields, lambda k, _: ~F.element_at(F.split(k, r"\."), -1).isin(*local))


def provenance_record(stream: Column, event: Column, seq: Column, fields: Column) -> Column:
    """A record with an id that depends on its place alone, and the fields that have a value."""
    return F.struct(F.format_string("%s:%s:%08d", stream.cast("string"), event, seq.cast("long")).alias("record_id"),
                    F.map_filter(fields, lambda _, v: v.isNotNull() & (v != "")).alias("fields"))


def decision_record(stream: Column, event: Column, seq: Column, outcome: Column, strength: Column) -> Column:
    """The causal part of a decision."""
    return F.struct(F.format_string("%s:%08d", stream.cast("string"), seq.cast("long")).alias("decision_id"),
                    event.alias("event"), outcome.alias("outcome"), strength.alias("strength"))


def observation_tags(reason: Column, active: Column, changed: Column) -> Column:
    """Unique tags in order."""
    return F.array_distinct(F.array_compact(F.array(
        F.when(reason != "", reason), F.when(active, F.lit("active")), F.when(~active, F.lit("idle")),
        F.when(changed > 2, F.lit("multi_cell")), F.when(changed == 0, F.lit("quiet")), F.when(reason.contains("spike"), F.lit("spike")))))


def endpoint_complete(changed: Column, origin: Column, target: Column, least: float = 6) -> Column:
    """False when at most one cell changed and an endpoint differs by less than ``least``."""
    return ~((changed <= 1) & ((origin < least) | (target < least)))


def veto_reliable(direct: Column, samples: Column, observed: Column, agreeing: Column) -> Column:
    """P19."""
    return direct & (samples >= 2) & (observed >= 2) & (agreeing >= 2)


def event_layer(event: Column) -> Column:
    """P20: the earliest layer that an event mismatch speaks for."""
    return (F.when(event.isin("CANDIDATE", "QUIET", "SETTLE_PROBE", "SETTLE_RETARGET"), "detector_or_scoring")
            .when(event.isin("VALIDATION_REJECTED", "REJECTED_FRAME", "HOVER_MEASURE", "CLOCK_STATE", "CLOCK_BACKFILL_CHECK"), "detector_or_validation")
            .when(event.rlike("^(REVERT|REBASE|HANDOFF|HISTORICAL)") | event.isin("ACCEPT", "COALESCED_STOP", "PRESERVED_MAINLINE_RESTORED", "MOVE_OVERRIDE"), "reducer")
            .otherwise("reducer_or_trace_contract"))


def is_decision(event: Column) -> Column:
    """P21."""
    return event.isin("ACCEPT", "VALIDATION_REJECTED", "REJECTED_FRAME", "SCORE_THRESHOLD_REJECTED", "ORIGIN_CANDIDATE") | event.rlike(
        "^(SETTLE_|REVERT|REBASE|HANDOFF|HISTORICAL)")


def finite_only(seconds: Column) -> Column:
    """Null for what is not finite, and no negative times."""
    bad = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf"))
    return F.when(~bad, F.greatest(seconds, F.lit(0.0)))
