"""Ordered operators W1-W20 and T1-T9: windows by stream, ranks and top-k.

Streams are ordered by (ts, event_id) or (seq); every order has a full tie-break. ``order`` is the list of
ordering columns and ``stream`` the partition column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from obsline.operators.scan import SEGMENT, scan

STREAM, ORDER = "stream_id", ("ts", "observation_id")


def along(stream: str = STREAM, *order: str) -> WindowSpec:
    return Window.partitionBy(stream).orderBy(*(order or ORDER))


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def motion_flags(obs: DataFrame, delta: float = 25, still: float = 0.005, spike: float = 0.045) -> DataFrame:
    """Share of cells that changed since the previous row; the first row counts as motion."""
    before = F.lag("cells").over(along())
    share = F.size(F.filter(F.zip_with("cells", before, lambda a, b: F.abs(a - b)), lambda d: d > delta)) / F.size("cells")
    found = obs.withColumn("changed_share", F.when(before.isNotNull(), share))
    return found.withColumn("has_motion", F.coalesce(F.col("changed_share") >= still, F.lit(True))).withColumn(
        "motion_spike", F.coalesce(F.col("changed_share") > spike, F.lit(False)))


def coalesce_bursts(obs: DataFrame, gap_seconds: float = 0.2) -> DataFrame:
    """W2, coarse form: bursts as islands of rows at most ``gap`` apart, with their first and last row.

    The exact emission rules keep state and are in streaming.bursts.
    """
    timed = scan(obs, STREAM, ORDER, previous={"before_us": micros()})
    marked = timed.withColumn("new", F.coalesce(micros() - F.col("before_us") > gap_seconds * 1e6, F.lit(True)).cast("int"))
    isles = scan(marked, STREAM, ORDER, sums={"burst": F.col("new")})
    return isles.groupBy(STREAM, "burst").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"),
        F.min_by("observation_id", F.struct(*ORDER)).alias("first_id"), F.max_by("observation_id", F.struct(*ORDER)).alias("last_id"))


def geometry_drift(probes: DataFrame, anchor: float = 24, step: float = 16) -> DataFrame:
    """Drift from the first probe and from the previous one; unstable beyond either limit."""
    w = along()
    first = w.rowsBetween(Window.unboundedPreceding, 0)

    def far(of) -> Column:
        return F.greatest(F.abs(F.col("x") - of("x")), F.abs(F.col("y") - of("y")))

    found = probes.withColumn("anchor_drift", far(lambda c: F.first(c).over(first))).withColumn(
        "step_drift", F.coalesce(far(lambda c: F.lag(c).over(w)), F.lit(0.0)))
    return found.withColumn("stable", (F.col("anchor_drift") <= anchor) & (F.col("step_drift") <= step))


def reading_deltas(readings: DataFrame, slack: int = 65, jump: int = 180) -> DataFrame:
    """Drop since the same side's previous reading; plausible and regressed flags (null for the first)."""
    before = F.lag("seconds").over(Window.partitionBy(STREAM, "side").orderBy(*ORDER))
    return readings.withColumn("drop", before - F.col("seconds")).withColumn("plausible", F.col("seconds") <= before + slack).withColumn(
        "regressed", F.col("seconds") - before >= jump)


def recent_inverse(moves: DataFrame, back: int = 4) -> DataFrame:
    """How many rows back, within ``back``, the most recent transition is that this one reverses; null if none."""
    recent = F.collect_list(F.concat_ws(">", "source", "target")).over(along().rowsBetween(-back, -1))
    own = F.concat_ws(">", "target", "source")
    at = F.array_position(F.reverse(recent), own)
    return moves.withColumn("inverse_back", F.when(at > 0, at))


def stale_tail(rows: DataFrame, low: int = 600, least_seconds: float = 1.0) -> DataFrame:
    """By stream the trailing run whose readings stand still below ``low``, with both sides seen.

    A row breaks the run if its reading differs from the same side's next one, or is high.
    """
    side_next = F.lead("seconds").over(Window.partitionBy(STREAM, "side").orderBy(*ORDER))
    broken = (~side_next.isNull() & (side_next != F.col("seconds"))) | (F.col("seconds") >= low) | F.col("seconds").isNull()
    back = Window.partitionBy(STREAM).orderBy(*(F.desc(c) for c in ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("broken", broken.cast("int")).withColumn("in_tail", F.max("broken").over(back) == 0).filter("in_tail")
    found = run.groupBy(STREAM).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count_distinct("side").alias("sides"))
    return found.filter((F.col("sides") == 2) & (F.unix_micros("stop") - F.unix_micros("start") >= least_seconds * 1e6)).drop("sides")


def carry_forward(df: DataFrame, value: str, *order: str) -> DataFrame:
    """The last known value and whether it is direct, inherited or missing."""
    found = scan(df, STREAM, order or ORDER, last={"carried": F.col(value)}).drop(SEGMENT)
    return found.withColumn(
        "provenance", F.when(F.col(value).isNotNull(), "direct").when(F.col("carried").isNotNull(), "inherited").otherwise("missing"))


def cue_ends(cues: DataFrame, longest: float = 5.0) -> DataFrame:
    """A cue ends after ``longest`` seconds, or at the next strictly later time that is no rollback."""
    at = F.when(~F.col("rollback"), F.col("seconds"))
    # Later times come first in the order turned round, so the frame grows with the rows.
    later = Window.partitionBy(STREAM).orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)
    timed = cues.withColumn("us", F.round(F.col("seconds") * 1e6).cast("long"))
    return timed.withColumn("cue_end", F.least(F.col("seconds") + longest, F.min(at).over(later))).drop("us")


def state_durations(rows: DataFrame, end: str) -> DataFrame:
    """Seconds until the next row; the last one until ``end``."""
    following = F.coalesce(F.lead("seconds").over(along(STREAM, "seconds", "seq")), F.col(end))
    return rows.withColumn("duration", following - F.col("seconds"))


def rank_cells(cells: DataFrame, least: float = 15, k: int | None = None) -> DataFrame:
    """Cells (position, score) of an observation with at least ``least``, greatest first."""
    w = Window.partitionBy("observation_id").orderBy(F.desc("score"), "cell")
    ranked = cells.select("observation_id", F.posexplode("cells").alias("cell", "score")).filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def score_margin(candidates: DataFrame, low: float = 10) -> DataFrame:
    """Best score less the second; low below ``low``; null with one candidate."""
    top = candidates.withColumn("at", F.row_number().over(Window.partitionBy("observation_id").orderBy(F.desc("score"), "candidate"))).filter("at <= 2")
    found = top.groupBy("observation_id").agg(F.max("score").alias("best"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second"))
    return found.withColumn("margin", F.col("best") - F.col("second")).withColumn("low_margin", F.coalesce(F.col("margin") < low, F.lit(False)))


def monotonic_check(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Rows whose value is below the previous row's."""
    found = scan(rows, STREAM, order or ORDER, previous={"previous": F.col(value)}).drop(SEGMENT)
    return found.filter(F.col(value) < F.col("previous"))


def duplicate_accepts(accepts: DataFrame) -> DataFrame:
    """An accept that repeats the one before it, or its candidate's second accept."""
    w = along()
    same = F.struct("move", "state", "branch_id").eqNullSafe(F.lag(F.struct("move", "state", "branch_id")).over(w)) & F.lag("observation_id").over(w).isNotNull()
    again = F.col("candidate_id").isNotNull() & (F.row_number().over(Window.partitionBy(STREAM, "candidate_id").orderBy(*ORDER)) > 1)
    kind = F.when(same, "repeated_accept").when(again, "candidate_accepted_twice")
    return accepts.withColumn("finding", kind).filter("finding IS NOT NULL")


def known_before(events: DataFrame) -> DataFrame:
    """Rollbacks whose target state did not appear before them."""
    first = F.min(F.when(~F.col("rollback"), F.struct(*ORDER))).over(Window.partitionBy(STREAM, "state"))
    return events.withColumn("first_seen", first).filter(
        F.col("rollback") & (F.col("first_seen").isNull() | (F.col("first_seen") >= F.struct(*ORDER)))).drop("first_seen")


def nesting_depth(tokens: DataFrame) -> DataFrame:
    """Depth of parentheses after each token (stream_id, pos, token)."""
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    return tokens.withColumn("depth", F.sum(step).over(along(STREAM, "pos").rowsBetween(Window.unboundedPreceding, 0)))


def material_delta(rows: DataFrame) -> DataFrame:
    """Change of material to the next row; a sacrifice if it turns against the side to move."""
    found = rows.withColumn("delta", F.lead("material").over(along(STREAM, "seq")) - F.col("material"))
    return found.withColumn("sacrifice", F.when(F.col("side") == "w", F.col("delta") < 0).otherwise(F.col("delta") > 0))


def last_good_before(events: DataFrame, good: Column, target: Column) -> DataFrame:
    """For each target row the last good one strictly before it."""
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("last_good", F.last(F.when(good, F.struct(*ORDER)), ignorenulls=True).over(before)).filter(target)


def label_transition(rows: DataFrame) -> DataFrame:
    """Quality of a transition from loss, best move, sacrifice and sequence (columns loss, is_best,
    lines, sacrifice, side_eval, second_gap, seq)."""
    fine = F.col("sacrifice") & (F.col("side_eval") > -200)
    label = (F.when((F.col("seq") < 10) & (F.col("loss") <= 25), "book")
             .when(F.col("is_best") & (F.col("lines") > 1) & fine & (F.col("second_gap") > 200) & (F.col("loss") <= 10), "brilliant")
             .when(F.col("is_best") & (F.col("lines") > 1) & fine, "great").when(F.col("is_best"), "best")
             .when(F.col("loss") <= 25, "good").when(F.col("loss") >= 300, "blunder")
             .when((F.col("loss") >= 150) & (F.col("side_eval") >= 200), "missed_win").when(F.col("loss") >= 75, "mistake").otherwise("none"))
    return rows.withColumn("label", label)


def mutation_check(events: DataFrame) -> DataFrame:
    """Rejected rows whose state differs from their candidate's first one in the same generation."""
    w = Window.partitionBy(STREAM, "candidate_id", "generation").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("baseline", F.first("state").over(w)).filter((F.col("outcome") == "rejected") & ~F.col("state").eqNullSafe(F.col("baseline")))


def transient_landing(obs: DataFrame, seconds: float = 2.5, weak: float = 70) -> DataFrame:
    """Weak transitions whose earlier state returns within the look-ahead (state_key, previous_key, score)."""
    ahead = Window.partitionBy(STREAM).orderBy(F.col("us")).rangeBetween(1, int(seconds * 1e6))
    timed = obs.withColumn("us", micros()).withColumn("ahead", F.collect_set("state_key").over(ahead))
    return timed.withColumn("transient", (F.col("score") < weak) & F.array_contains("ahead", F.col("previous_key"))).drop("us", "ahead")


def chronological(obs: DataFrame) -> DataFrame:
    """Streams in order within partitions."""
    return obs.repartition(STREAM).sortWithinPartitions(STREAM, *ORDER)


def top_candidates(df: DataFrame, k: int = 3, by: str = "observation_id") -> DataFrame:
    """T2."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "candidate"))).filter(F.col("rank") <= k)


def candidate_frequency(states: DataFrame) -> DataFrame:
    """Each candidate id of a stream's states with its count and its first place, deepest state first."""
    deepest = F.row_number().over(Window.partitionBy(STREAM).orderBy(F.desc("seq")))
    return states.withColumn("place", deepest).select(STREAM, "place", F.posexplode("ids").alias("at", "id")).groupBy(STREAM, "id").agg(
        F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("first"))


def candidate_shortlist(freq: DataFrame, k: int = 8) -> DataFrame:
    """T4: candidates by first place, then count."""
    w = Window.partitionBy(STREAM).orderBy("first", F.desc("n"), "id")
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def resolve_identity(matches: DataFrame) -> DataFrame:
    """T5: of verified candidates the one of newest date, then earliest place, then greatest count."""
    date = F.regexp_replace(F.coalesce("date", F.lit("")), "[^0-9]", "")
    w = Window.partitionBy(STREAM).orderBy(F.desc(date), "first", F.desc("n"), "id")
    return matches.filter("verified").withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


def best_candidate(df: DataFrame, by: str = "observation_id") -> DataFrame:
    """The candidate of greatest score; ties go to the name that sorts first."""
    return df.groupBy(by).agg(F.min_by("candidate", F.struct(-F.col("score"), F.col("candidate"))).alias("candidate"), F.max("score").alias("score"))


def latest_ranked_lines(log: DataFrame) -> DataFrame:
    """By state and rank the last line of an engine's log."""
    return log.groupBy("state", "rank").agg(F.max_by(F.struct("move", "pv", "cp", "mate"), "pos").alias("line")).select("state", "rank", "line.*")


def two_highest_cells(obs: DataFrame) -> DataFrame:
    """The two highest cells of (observation_id, cells); the first is the source if its edge score is lower."""
    scored = F.transform("cells", lambda x, i: F.struct((-x).alias("k"), i.alias("cell")))
    two = F.slice(F.array_sort(scored), 1, 2)
    found = obs.withColumn("two", two)
    a, b = F.col("two")[0], F.col("two")[1]
    swap = F.col("edges").getItem(a["cell"]) > F.col("edges").getItem(b["cell"])
    return found.select("observation_id", F.when(swap, b["cell"]).otherwise(a["cell"]).alias("source"),
                        F.when(swap, a["cell"]).otherwise(b["cell"]).alias("target"), (-a["k"]).alias("best"), (-b["k"]).alias("second"))


def ranked_candidates(df: DataFrame, k: int = 8) -> DataFrame:
    """Top candidates with the margin to the next and a gate on each (origin, target scores)."""
    from obsline.functions.rules import highlight_gate

    w = Window.partitionBy("observation_id").orderBy(F.desc("score"), "candidate")
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w))
    return ranked.filter(F.col("rank") <= k).withColumn("decision", highlight_gate(F.col("origin"), F.col("target")))
