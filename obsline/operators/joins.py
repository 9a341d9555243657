"""Joins J1-J24: alignment of traces, look-ahead, similarity, enrichment.

All joins are equi joins on a stream or key with further conditions; ranges are cut into buckets. The one
quadratic form, similar_state_exhaustive, is so within a stream and is there for comparison.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsline.functions.scalars import bucket_of, distance_max, distance_mean, pack_buckets, quadrants, state_key
from obsline.operators.scan import scan
from obsline.operators.similar import best_in_blocks, sound
from obsline.operators.windows import ORDER, STREAM, micros

#: Pairs of a part of a key that sequences and games share.
MEETINGS = 250_000


def compare_by_id(expected: DataFrame, actual: DataFrame, fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(stream_id, observation_id, finding): missing, unexpected, field, vector and event mismatches."""
    key = [STREAM, "observation_id"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct("cells", "events", *fields).alias(name))

    both = side(expected, "e").join(side(actual, "a"), key, "full_outer")
    findings = F.array_compact(F.array(
        F.when(F.col("a").isNull(), "missing"), F.when(F.col("e").isNull(), "unexpected"),
        *(F.when(F.col("a").isNotNull() & F.col("e").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"e.{f}")), f"field:{f}") for f in fields),
        F.when(F.col("a").isNotNull() & F.col("e").isNotNull()
               & F.coalesce(distance_max(F.col("a.cells"), F.col("e.cells")) > tolerance, ~F.size("a.cells").eqNullSafe(F.size("e.cells"))), "vector"),
        F.when(F.col("a").isNotNull() & F.col("e").isNotNull() & ~F.col("a.events").eqNullSafe(F.col("e.events")), "events")))
    return both.select(*key, F.explode(findings).alias("finding"))


def compare_by_position(expected: DataFrame, actual: DataFrame, value: str, *by: str, first_only: bool = False) -> DataFrame:
    """Sequences aligned by rank within ``by``; the positions (or the first one) where they differ."""
    keys = list(by or (STREAM,))
    w = Window.partitionBy(*keys).orderBy(*ORDER)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, (F.row_number().over(w) - 1).alias("position"), F.col(value).alias(name))

    off = ranked(expected, "expected").join(ranked(actual, "actual"), [*keys, "position"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    if not first_only:
        return off
    return off.groupBy(*keys).agg(F.min_by(F.struct("position", "expected", "actual"), "position").alias("x")).select(*keys, "x.*")


def lookahead(df: DataFrame, seconds: float, aggregates: dict[str, Column], ts: str = "ts", stream: str = STREAM) -> DataFrame:
    """J3, one-sided: aggregates over the rows up to ``seconds`` later, the row itself included."""
    w = Window.partitionBy(stream).orderBy(F.col("__us")).rangeBetween(0, int(seconds * 1e6))
    timed = df.withColumn("__us", micros(ts))
    return timed.withColumns({name: a.over(w) for name, a in aggregates.items()}).drop("__us")


def lookahead_join(left: DataFrame, right: DataFrame, seconds: float, ts: str = "ts", stream: str = STREAM) -> DataFrame:
    """J3, two-sided: pairs with left.ts <= right.ts <= left.ts + seconds, by time buckets of that width.

    A left row looks into its bucket and the next one, so each pair is met once.
    """
    width = int(seconds * 1e6)
    lu, ru = micros(ts), micros(ts)
    a = left.withColumn("l_us", lu).withColumn("bucket", F.explode(F.array(F.floor(lu / width), F.floor(lu / width) + 1)))
    b = right.select(F.col(stream), F.floor(ru / width).alias("bucket"), ru.alias("r_us"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != stream))
    return a.join(b, [stream, "bucket"]).filter((F.col("r_us") >= F.col("l_us")) & (F.col("r_us") - F.col("l_us") <= width)).drop("bucket", "l_us", "r_us")


def similar_state_join(obs: DataFrame, history: DataFrame, radius: int = 1, cell: float = 15, mean: float = 8, full: float = 3.5,
                       mode: str = "best") -> DataFrame:
    """For each observation the earlier state of its stream that it returns to.

    Four quadrant means in buckets of 8 must each lie within ``radius`` buckets (radius 2 misses nothing under
    these limits). Then the greatest cell difference, the mean difference and the mean over all cells decide. ``best`` has
    the least difference, ``most_recent`` the latest. The latest state before the observation is left out.
    """
    # Buckets are cut into blocks of 2 * radius + 1. A history state has one block, an observation looks into the one
    # or two that its range of buckets touches in each quarter: 16 keys at most, and a pair meets once. Quarters that
    # differ by more than the mean allows in all are left out: their cells make up 16 times the sum.
    width, limit = 2 * radius + 1, min(mean, full)

    def quarters(df: DataFrame) -> DataFrame:
        # Exploded, as the optimiser would else copy the sums into each place where a mean is used.
        means = df.withColumn("m", F.explode(F.array(F.array(*quadrants(F.col("cells"))))))
        q = [bucket_of(F.col("m")[i]) for i in range(4)]
        return means.withColumns({"packed": pack_buckets(q)} | {f"q{i}": q[i] for i in range(4)})

    def block(of: Column) -> Column:
        return F.floor(of / width).cast("long") + 1

    def looked(i: int) -> Column:
        """Blocks of a quarter that an observation looks into, and how far their means are from its own."""
        m = F.col("m")[i]

        def far(k: Column) -> Column:
            low = F.when(k <= 1, float("-inf")).otherwise((k * width - width - 0.5) * 8)
            high = F.when(k * width > 63, float("inf")).otherwise((k * width - 0.5) * 8)
            return F.struct(k.alias("k"), F.greatest(low - m, m - high, F.lit(0.0)).alias("far"))

        return F.transform(F.array_distinct(F.array(block(F.col(f"q{i}") - radius), block(F.col(f"q{i}") + radius))), lambda k: far(k))

    ob = quarters(obs.filter(sound(F.col("cells"))))
    for i in range(4):
        ob = ob.withColumn(f"k{i}", F.explode(looked(i)))
    ob = ob.filter(sum((F.col(f"k{i}.far") for i in range(4)), F.lit(0.0)) <= F.size("cells") * limit / 16 + 1e-6)
    ob = ob.withColumn("key", pack_buckets([F.col(f"k{i}.k") for i in range(4)]))
    h = quarters(history.filter(sound(F.col("cells")))).withColumn("key", pack_buckets([block(F.col(f"q{i}")) for i in range(4)]))
    return best_in_blocks(ob, h, cell, limit, mode, radius=radius)


def similar_state_exhaustive(obs: DataFrame, history: DataFrame, cell: float = 15, full: float = 3.5, mode: str = "best", last: int | None = None) -> DataFrame:
    """As J4 without keys: all earlier states of the stream, or its ``last`` ones. Time is quadratic in a stream, memory and rows are not."""
    same = F.lit(0).cast("long")
    return best_in_blocks(obs.withColumns({"key": same, "packed": same}), history.withColumns({"key": same, "packed": same}), cell, full, mode, last=last)


def nearest_in_time(timeline: DataFrame, durable: DataFrame) -> DataFrame:
    """Entries in time order each take the nearest durable observation of their transition that is still unused.

    Adds ``d_id``, ``d_ts`` and ``distance`` in seconds; null where none is left. Ties go to the earlier observation,
    then to the lesser id. What an entry takes depends on those before it, so a (stream, transition) passes
    through one task in order; only times and ids do, and the unused observations are kept as sorted lists.
    """
    kind = {f.name: f.dataType.simpleString() for f in timeline.schema}
    d_kind = {f.name: f.dataType.simpleString() for f in durable.schema}
    group = [STREAM, "transition"]
    a = timeline.select(*group, F.lit(1).alias("side"), micros("ts").alias("us"), "observation_id", F.lit(None).cast(d_kind["observation_id"]).alias("d_id"))
    b = durable.select(*group, F.lit(0).alias("side"), micros("ts").alias("us"), F.lit(None).cast(kind["observation_id"]).alias("observation_id"), F.col("observation_id").alias("d_id"))

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times, ids = object(), [], []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(None if x != x else x for x in row[:2])
                if key != now:
                    now, times, ids = key, [], []
                if row.side == 0:
                    times.append(row.us)
                    ids.append(row.d_id)
                    continue
                if not times:
                    continue
                at = bisect.bisect_left(times, row.us)
                if at == len(times) or at and row.us - times[at - 1] <= times[at] - row.us:
                    at = bisect.bisect_left(times, times[at - 1])  # the first of equal times
                out.append((row[0], row[1], row.observation_id, ids.pop(at), times.pop(at)))
            yield pd.DataFrame(out, columns=[*group, "observation_id", "d_id", "d_us"])

    rows = a.unionByName(b).repartition(*group).sortWithinPartitions(*group, "side", "us", F.coalesce("d_id", F.lit(0)), "observation_id")
    taken = rows.mapInPandas(pair, f"{STREAM} {kind[STREAM]}, transition {kind['transition']}, observation_id {kind['observation_id']}, d_id {d_kind['observation_id']}, d_us long")
    found = timeline.join(taken, [*group, "observation_id"], "left")
    return found.withColumn("distance", F.abs(micros("ts") - F.col("d_us")) / 1e6).withColumn("d_ts", F.timestamp_micros("d_us").cast(d_kind["ts"])).drop("d_us")


def state_key_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """States by their first four fields."""
    a = left.withColumn("state_key", state_key(F.col("state")))
    b = right.select(STREAM, state_key(F.col("state")).alias("state_key"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in (STREAM,)))
    return a.join(b, [STREAM, "state_key"], how)


def missing_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other side lacks."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def known_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def contains_sequence(games: DataFrame, observed: DataFrame) -> DataFrame:
    """(stream_id, game_id, start) where a game holds the stream's whole key sequence in a row.

    Both are (id, pos, key), pos from 0. Sequences meet games on their first two keys together (those of one step
    on that), and only at these starts are the other steps compared. A key that many share is dealt over parts of some
    ``MEETINGS`` pairs: a place has one part, a sequence is copied to all.
    """
    spark = games.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meet(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
        n = a.groupBy(*on).agg(F.count("*").alias("n_a")).join(b.groupBy(*on).agg(F.count("*").alias("n_b")), [*on])
        n = n.select(*on, F.ceil(F.least(F.col("n_a") * F.col("n_b").cast("double") / MEETINGS, F.col("n_b"))).cast("int").alias("parts"))
        # A number of partitions of its own: few bytes make many pairs, so that small inputs are not to be put together.
        spread = b.join(n, [*on]).withColumn("part", F.pmod(F.xxhash64("game_id", "start"), "parts").cast("int")).drop("parts").repartition(parts, *on, "part")
        copied = a.join(n, [*on]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(parts, *on, "part")
        return copied.join(spread, [*on, "part"]).drop("part")

    def openings(df: DataFrame, ident: str) -> DataFrame:
        w = Window.partitionBy(ident).orderBy("pos")
        return df.withColumn("next", F.lead("key").over(w)).withColumn("after", F.lead("pos").over(w)).withColumn("next", F.when(F.col("after") == F.col("pos") + 1, F.col("next")))

    sizes = observed.groupBy(STREAM).agg(F.count("*").alias("size"))
    heads = openings(observed, STREAM).filter("pos = 0").join(sizes, STREAM).select(STREAM, "size", F.col("key").alias("h_key"), F.col("next").alias("h_next"))
    places = openings(games, "game_id").select("game_id", F.col("pos").alias("start"), F.col("key").alias("h_key"), F.col("next").alias("h_next"))
    starts = meet(heads.filter("size > 1"), places, "h_key", "h_next").unionByName(meet(heads.filter("size = 1").drop("h_next"), places, "h_key"))
    starts = starts.select(STREAM, "size", "game_id", "start")
    steps = starts.filter("size > 2").join(observed.filter("pos > 1").select(STREAM, "pos", "key"), STREAM).withColumn("pos", F.col("pos") + F.col("start"))
    agree = steps.join(games.select("game_id", "pos", "key"), ["game_id", "pos", "key"]).groupBy(STREAM, "game_id", "start", "size").agg(F.count("*").alias("n"))
    whole = agree.filter(F.col("n") == F.col("size") - 2).select(STREAM, "game_id", "start")
    return starts.filter("size <= 2").select(STREAM, "game_id", "start").unionByName(whole)


def keyword_match(names: DataFrame, templates: list[tuple[str, list[str]]], fallback: str) -> DataFrame:
    """The first template (in order) one of whose words is in the lower-cased name; else the fallback."""
    pick = F.lit(None).cast("string")
    for template, words in reversed(templates):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.lower("name"), F.lit(word.lower()))
        pick = F.when(hit, template).otherwise(pick)
    return names.withColumn("template", F.coalesce(pick, F.lit(fallback)))


def lookup_enrich(timeline: DataFrame, lookup: DataFrame) -> DataFrame:
    """Code and name by state, the last one found carried on along the stream."""
    found = timeline.join(lookup.select("state_key", F.struct("code", "name").alias("own_hit")), "state_key", "left")
    return scan(found, STREAM, ("seq",), last={"hit": F.col("own_hit")}).select(*timeline.columns, "hit.code", "hit.name")


def before_after_evaluation(timeline: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Each transition's best line before it and the next state's best line after it."""
    best = evaluations.filter("rank = 1").select("state_key", "cp", "move")
    found = timeline.join(best, "state_key", "left")
    w = Window.partitionBy(STREAM).orderBy("seq")
    return found.withColumn("cp_after", F.lead("cp").over(w)).withColumnRenamed("cp", "cp_before").withColumnRenamed("move", "best_move")


def score_candidates(diffs: DataFrame, candidates: DataFrame) -> DataFrame:
    """A candidate's score: the differences at its cells, less 20 for four cells and 10 for three."""
    cells = diffs.select("observation_id", F.posexplode("cells").alias("cell", "diff"))
    wanted = candidates.select("observation_id", "candidate", F.size("squares").alias("n"), F.explode("squares").alias("cell"))
    adjust = F.when(F.col("n") == 4, -20).when(F.col("n") == 3, -10).otherwise(0)
    return wanted.join(cells, ["observation_id", "cell"]).groupBy("observation_id", "candidate").agg((F.sum("diff") + F.first(adjust)).alias("score"))


def missing_artifacts(records: DataFrame, listing: DataFrame, columns: list[str], pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """Referenced paths that a listing lacks, and pairs of which one is there alone."""
    tall = records.select("observation_id", F.explode(F.array(*(F.struct(F.lit(c).alias("artifact"), F.col(c).alias("path")) for c in columns))).alias("x")).select(
        "observation_id", "x.*").filter("path IS NOT NULL AND path <> ''")
    gone = tall.join(listing.select("path").distinct(), "path", "left_anti").select("observation_id", "artifact", F.lit("missing").alias("finding"))
    for a, b in pairs:
        lone = records.filter((F.coalesce(a, F.lit("")) == "") != (F.coalesce(b, F.lit("")) == ""))
        gone = gone.unionByName(lone.select("observation_id", F.lit(f"{a}|{b}").alias("artifact"), F.lit("unpaired").alias("finding")))
    return gone


def multiset_delta(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counts differ, with how many are missing or extra."""
    e, a = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((expected, "e"), (actual, "a")))
    both = e.join(a, keys, "full_outer").withColumn("delta", F.coalesce("a", F.lit(0)) - F.coalesce("e", F.lit(0)))
    return both.filter("delta <> 0").select(*keys, F.greatest(-F.col("delta"), F.lit(0)).alias("missing"), F.greatest("delta", F.lit(0)).alias("extra"))


def in_interval(events: DataFrame, bounds: DataFrame, ts: str = "ts", seconds: float = 86_400) -> DataFrame:
    """Pairs of events and bounds (stream_id, start, stop, ...) with start <= ts <= stop, by time buckets of a width.

    A bound has a row for each bucket that it touches, so long streams are dealt over time; choose ``seconds`` near
    the usual length of a bound. Columns of bounds other than the stream follow those of events.
    """
    width = int(seconds * 1e6)
    spread = bounds.withColumn("bucket", F.explode(F.sequence(F.floor(micros("start") / width), F.floor(micros("stop") / width)))).filter(F.col("stop") >= F.col("start"))
    return events.withColumn("bucket", F.floor(micros(ts) / width)).join(spread, [STREAM, "bucket"]).filter(F.col(ts).between(F.col("start"), F.col("stop"))).drop("bucket")


def decision_interval(events: DataFrame, bounds: DataFrame, seconds: float = 86_400) -> DataFrame:
    """Events between a report's last good time and its target (report_id, stream_id, start, stop)."""
    return in_interval(events, bounds, seconds=seconds)


def rank_history_sources(obs: DataFrame, history: DataFrame, last: int = 64, weight: float = 4) -> DataFrame:
    """Of the ``last`` states before an observation the one from which a transition explains it best.

    obs: (stream_id, observation_id, seq, score, active_diff); history: (stream_id, seq, source_diff). States are
    numbered by stream, and observations meet the blocks of ``last`` numbers that theirs and the one before are in.
    """
    both = history.select(STREAM, "seq", F.lit(1).alias("is_state"), "source_diff", F.lit(None).alias("x")).unionByName(
        obs.select(STREAM, "seq", F.lit(0).alias("is_state"), F.lit(None).alias("source_diff"), F.struct("observation_id", "score", "active_diff").alias("x")), allowMissingColumns=True)
    before = Window.partitionBy(STREAM).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("n", F.coalesce(F.sum("is_state").over(before), F.lit(0)))  # states before it
    states = counted.filter("is_state = 1").select(STREAM, F.col("seq").alias("source_seq"), "source_diff", F.col("n").alias("place"), F.floor(F.col("n") / last).alias("block"))
    asks = counted.filter("is_state = 0").select(STREAM, "seq", "x.*", "n", F.explode(F.array(F.floor(F.col("n") / last), F.floor(F.col("n") / last) - 1)).alias("block"))
    near = asks.join(states, [STREAM, "block"]).filter((F.col("place") < F.col("n")) & (F.col("place") >= F.col("n") - last))
    quality = F.col("score") + weight * (F.col("active_diff") - F.col("source_diff"))
    return near.withColumn("quality", quality).groupBy(STREAM, "observation_id").agg(
        F.max_by(F.struct("source_seq", "quality"), F.struct(F.round("quality", 9), "source_seq")).alias("b")).select(STREAM, "observation_id", "b.*")


def best_earlier_reading(obs: DataFrame, seconds: float = 15, similar: float = 20, retained: int = 180) -> DataFrame:
    """A reading for rows without one: that of the most similar row within ``seconds`` before, else the
    retained one if it is within ``retained`` of the last known."""
    held = obs.filter("reading IS NOT NULL").select(STREAM, "ts", F.col("cells").alias("cells2"), F.col("reading").alias("reading2"), "observation_id")
    need = obs.filter("reading IS NULL").select(STREAM, "observation_id", "ts", "cells")
    pairs = lookahead_join(held, need, seconds).withColumn("diff", distance_mean(F.col("cells2"), F.col("r_cells"))).filter(F.col("diff") <= similar)
    best = pairs.groupBy(STREAM, F.col("r_observation_id").alias("observation_id")).agg(F.min_by("reading2", F.struct("diff", -F.col("observation_id"))).alias("found"))
    joined = obs.join(best, [STREAM, "observation_id"], "left")
    last = F.last("reading", ignorenulls=True).over(Window.partitionBy(STREAM).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    kept = F.when(F.abs(F.col("retained") - last) <= retained, F.col("retained"))
    return joined.withColumn("resolved", F.coalesce("reading", "found", kept)).drop("found")


def transposition_edges(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """The states from which a transition gives the matched state: edges (parent_key, transition, child_key)."""
    return matched.join(edges.select(STREAM, "transition", F.col("child_key").alias("state_key"), "parent_key").distinct(), [STREAM, "transition", "state_key"])
