"""Queries over streams in order: windows W1-W20, ranks T1-T9, look-ahead J3, rules P8-P22, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsline.functions import rules, scalars
from obsline.operators import evidence, joins
from obsline.operators import windows as W
from obsline.plans.base import ORD, E, G, T, V, events, game, query, rounded, table, trace, vectors


@query("w1_motion_flags", f"""WITH {V}, M AS (SELECT stream_id, seq, observation_id, cells, lag(cells) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM V),
  S AS (SELECT observation_id, CASE WHEN b IS NOT NULL THEN len(list_filter(list_transform(range(1, 65), lambda i: abs(cells[i] - b[i])), lambda d: d > 25)) / 64 END AS changed_share FROM M)
  SELECT observation_id, changed_share, coalesce(changed_share >= 0.005, true) AS has_motion, coalesce(changed_share > 0.045, false) AS motion_spike FROM S""")
def w1(spark, sf):
    obs = vectors(spark, sf).withColumn("ts", F.timestamp_seconds("seq"))
    return W.motion_flags(obs).select("observation_id", "changed_share", "has_motion", "motion_spike")


@query("w2_coalesce_bursts", f"""WITH {E}, N AS (SELECT *, CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORD}) > 7200000000, true) AS INT) AS new FROM E),
  I AS (SELECT *, sum(new) OVER ({ORD}) AS burst FROM N) SELECT stream_id, CAST(burst AS BIGINT) AS burst, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
  arg_min(observation_id, (ts, observation_id)) AS first_id, arg_max(observation_id, (ts, observation_id)) AS last_id FROM I GROUP BY stream_id, burst""")
def w2(spark, sf):
    return W.coalesce_bursts(events(spark, sf), gap_seconds=7200)


@query("w3_geometry_drift", f"""WITH {E}, P AS (SELECT *, value AS x, CAST(k AS DOUBLE) AS y FROM E), D AS (SELECT observation_id,
  greatest(abs(x - first(x) OVER ({ORD} ROWS UNBOUNDED PRECEDING)), abs(y - first(y) OVER ({ORD} ROWS UNBOUNDED PRECEDING))) AS a,
  coalesce(greatest(abs(x - lag(x) OVER ({ORD})), abs(y - lag(y) OVER ({ORD}))), 0) AS s FROM P)
  SELECT observation_id, round(a, 6) AS anchor_drift, round(s, 6) AS step_drift, a <= 24 AND s <= 16 AS stable FROM D""")
def w3(spark, sf):
    p = events(spark, sf).withColumn("x", F.col("value")).withColumn("y", F.col("k").cast("double"))
    return rounded(W.geometry_drift(p).select("observation_id", "anchor_drift", "step_drift", "stable"), digits=6)


@query("w4_reading_deltas", f"""WITH {E}, B AS (SELECT *, lag(seconds) OVER (PARTITION BY stream_id, side ORDER BY ts, observation_id) AS b FROM E)
  SELECT observation_id, b - seconds AS "drop", seconds <= b + 65 AS plausible, seconds - b >= 180 AS regressed FROM B""")
def w4(spark, sf):
    return W.reading_deltas(events(spark, sf)).select("observation_id", "drop", "plausible", "regressed")


@query("w5_recent_inverse", f"""WITH {E}, M AS (SELECT *, event_type AS source, lead(event_type, 1, 'end') OVER ({ORD}) AS target FROM E),
  B AS (SELECT observation_id, target || '>' || source AS own, lag(source || '>' || target, 1) OVER ({ORD}) AS p1, lag(source || '>' || target, 2) OVER ({ORD}) AS p2,
  lag(source || '>' || target, 3) OVER ({ORD}) AS p3, lag(source || '>' || target, 4) OVER ({ORD}) AS p4 FROM M)
  SELECT observation_id, CAST(CASE WHEN own = p1 THEN 1 WHEN own = p2 THEN 2 WHEN own = p3 THEN 3 WHEN own = p4 THEN 4 END AS BIGINT) AS inverse_back FROM B""")
def w5(spark, sf):
    m = events(spark, sf).withColumn("source", F.col("event_type")).withColumn("target", F.lead("event_type", 1, "end").over(W.along()))
    return W.recent_inverse(m).select("observation_id", "inverse_back")


@query("w6_stale_tail", f"""WITH {E}, N AS (SELECT *, lead(seconds // 450) OVER (PARTITION BY stream_id, side ORDER BY ts, observation_id) AS nx FROM E),
  B AS (SELECT *, CAST((nx IS NOT NULL AND nx <> seconds // 450) OR seconds // 450 >= 2 OR seconds IS NULL AS INT) AS broken FROM N),
  R AS (SELECT *, max(broken) OVER (PARTITION BY stream_id ORDER BY ts DESC, observation_id DESC ROWS UNBOUNDED PRECEDING) AS m FROM B)
  SELECT stream_id, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM R WHERE m = 0 GROUP BY stream_id HAVING count(DISTINCT side) = 2 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 1000000""")
def w6(spark, sf):
    return W.stale_tail(events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seconds", F.floor(F.col("seconds") / 450)), low=2)


@query("w7_carry_forward", f"""WITH {E}, C AS (SELECT *, CASE WHEN event_type = 'purchase' THEN k END AS v FROM E), D AS (SELECT observation_id, v, last_value(v IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS carried FROM C)
  SELECT observation_id, carried, CASE WHEN v IS NOT NULL THEN 'direct' WHEN carried IS NOT NULL THEN 'inherited' ELSE 'missing' END AS provenance FROM D""")
def w7(spark, sf):
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("k")))
    return W.carry_forward(e, "v", "ts", "observation_id").select("observation_id", "carried", "provenance")


@query("w8_cue_ends", f"""WITH {E}, S AS (SELECT stream_id, observation_id, epoch_us(ts) AS us, epoch_us(ts) / 1000000 AS s, event_type = 'signup' AS rb FROM E)
  SELECT observation_id, round(least(s + 36000, min(CASE WHEN NOT rb THEN s END) OVER (PARTITION BY stream_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 3) AS cue_end FROM S""")
def w8(spark, sf):
    c = events(spark, sf).select("stream_id", "observation_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), (F.col("event_type") == "signup").alias("rollback"))
    return rounded(W.cue_ends(c, 36000).select("observation_id", "cue_end"), digits=3)


@query("w9_state_durations", f"""WITH {E}, S AS (SELECT observation_id, stream_id, ts, epoch_us(ts) / 1000000 AS s FROM E), D AS (SELECT observation_id, lead(s) OVER (PARTITION BY stream_id ORDER BY s, observation_id) - s AS d,
  max(s) OVER (PARTITION BY stream_id) + 5 - s AS l FROM S) SELECT observation_id, round(coalesce(d, l), 3) AS duration FROM D""")
def w9(spark, sf):
    from pyspark.sql import Window

    c = events(spark, sf).select("stream_id", F.col("observation_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    c = c.withColumn("end_s", F.max("seconds").over(Window.partitionBy("stream_id")) + 5)
    return rounded(W.state_durations(c, "end_s").select(F.col("seq").alias("observation_id"), "duration"), digits=3)


@query("w10_rank_cells", f"""WITH {V}, C AS (SELECT observation_id, unnest(cells) AS score, generate_subscripts(cells, 1) - 1 AS cell FROM V), R AS (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY score DESC, cell) AS r FROM C WHERE score >= 150)
  SELECT observation_id, CAST(cell AS INT) AS cell, round(score, 6) AS score, CAST(r AS INT) AS rank FROM R WHERE r <= 8""")
def w10(spark, sf):
    return rounded(W.rank_cells(vectors(spark, sf), 150, 8), digits=6)


@query("w11_score_margin", f"""WITH {T}, R AS (SELECT stream_id, score, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, observation_id) AS r FROM T),
  M AS (SELECT stream_id, max(score) AS best, max(score) FILTER (r = 2) AS second FROM R WHERE r <= 2 GROUP BY stream_id)
  SELECT stream_id AS observation_id, best, second, round(best - second, 6) AS margin, coalesce(best - second < 10, false) AS low_margin FROM M""")
def w11(spark, sf):
    c = trace(spark, sf).select(F.col("stream_id").alias("observation_id"), "score", F.col("observation_id").alias("candidate"))
    return rounded(W.score_margin(c), "margin", digits=6)


@query("w12_monotonic_check", f"WITH {E}, P AS (SELECT observation_id, seconds, lag(seconds) OVER ({ORD}) AS previous FROM E) SELECT observation_id, seconds, previous FROM P WHERE seconds < previous")
def w12(spark, sf):
    return W.monotonic_check(events(spark, sf), "seconds").select("observation_id", "seconds", "previous")


@query("w13_duplicate_accepts", f"""WITH {T}, A AS (SELECT *, lag(move || state || branch_id) OVER ({ORD}) AS p, row_number() OVER (PARTITION BY stream_id, candidate_id ORDER BY ts, observation_id) AS r FROM T WHERE event = 'ACCEPT'),
  F AS (SELECT observation_id, CASE WHEN move || state || branch_id = p THEN 'repeated_accept' WHEN r > 1 THEN 'candidate_accepted_twice' END AS finding FROM A) SELECT * FROM F WHERE finding IS NOT NULL""")
def w13(spark, sf):
    return W.duplicate_accepts(trace(spark, sf).filter("event = 'ACCEPT'")).select("observation_id", "finding")


@query("w14_known_before", f"""WITH {T}, F AS (SELECT *, min(CASE WHEN event <> 'REVERT_APPLIED' THEN epoch_us(ts) END) OVER (PARTITION BY stream_id, k) AS f FROM T)
  SELECT observation_id FROM F WHERE event = 'REVERT_APPLIED' AND (f IS NULL OR f >= epoch_us(ts))""")
def w14(spark, sf):
    e = trace(spark, sf).withColumn("rollback", F.col("event") == "REVERT_APPLIED").withColumn("state", F.col("k"))
    return W.known_before(e).select("observation_id")


@query("w15_nesting_depth", r"""WITH K AS (SELECT page_id AS stream_id, unnest(regexp_extract_all(html, '<(/?)(div|p|article|ul|li|nav)\b')) AS t, generate_subscripts(regexp_extract_all(html, '<(/?)(div|p|article|ul|li|nav)\b'), 1) - 1 AS pos FROM pages),
  D AS (SELECT stream_id, pos, sum(CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d FROM K)
  SELECT stream_id, count(*) AS n, CAST(max(d) AS BIGINT) AS deepest, CAST(arg_max(d, pos) AS BIGINT) AS last FROM D GROUP BY stream_id""")
def w15(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("stream_id"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(<(/?)(div|p|article|ul|li|nav)\b)"), F.lit(1))).alias("pos", "t"))
    d = W.nesting_depth(p.withColumn("token", F.when(F.col("t").startswith("</"), ")").otherwise("(")))
    return d.groupBy("stream_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.max_by("depth", "pos").alias("last"))


@query("w16_material_delta", """WITH M AS (SELECT user_id AS stream_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS material, CASE WHEN event_id % 2 = 1 THEN 'w' ELSE 'b' END AS side FROM events),
  D AS (SELECT *, lead(material) OVER (PARTITION BY stream_id ORDER BY seq) - material AS delta FROM M) SELECT stream_id, seq, delta, CASE WHEN side = 'w' THEN delta < 0 ELSE delta > 0 END AS sacrifice FROM D""")
def w16(spark, sf):
    m = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("value").cast("long").alias("material"),
                                          F.when(F.col("event_id") % 2 == 1, "w").otherwise("b").alias("side"))
    return W.material_delta(m).select("stream_id", "seq", "delta", "sacrifice")


@query("w17_last_good_before", f"""WITH {T}, B AS (SELECT observation_id, event, last_value(CASE WHEN event = 'ACCEPT' THEN observation_id END IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_good FROM T)
  SELECT observation_id, last_good FROM B WHERE event = 'VALIDATION_REJECTED'""")
def w17(spark, sf):
    found = W.last_good_before(trace(spark, sf), F.col("event") == "ACCEPT", F.col("event") == "VALIDATION_REJECTED")
    return found.select("observation_id", F.col("last_good.observation_id").alias("last_good"))


@query("w18_label_transition", """WITH R AS (SELECT l_orderkey AS stream_id, l_linenumber AS seq, CAST(floor(l_extendedprice) AS BIGINT) % 400 AS loss, l_partkey % 3 = 0 AS is_best, 2 AS lines, l_suppkey % 2 = 0 AS sacrifice,
  CAST(floor(l_quantity) AS BIGINT) * 20 - 400 AS side_eval, l_partkey % 500 AS second_gap FROM lineitem)
  SELECT CASE WHEN seq < 2 AND loss <= 25 THEN 'book' WHEN is_best AND sacrifice AND side_eval > -200 AND second_gap > 200 AND loss <= 10 THEN 'brilliant' WHEN is_best AND sacrifice AND side_eval > -200 THEN 'great' WHEN is_best THEN 'best'
  WHEN loss <= 25 THEN 'good' WHEN loss >= 300 THEN 'blunder' WHEN loss >= 150 AND side_eval >= 200 THEN 'missed_win' WHEN loss >= 75 THEN 'mistake' ELSE 'none' END AS label, count(*) AS n FROM R GROUP BY label""")
def w18(spark, sf):
    r = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") + 8).alias("seq"), (F.col("l_extendedprice").cast("long") % 400).alias("loss"), (F.col("l_partkey") % 3 == 0).alias("is_best"), F.lit(2).alias("lines"),
        (F.col("l_suppkey") % 2 == 0).alias("sacrifice"), (F.col("l_quantity").cast("long") * 20 - 400).alias("side_eval"), (F.col("l_partkey") % 500).alias("second_gap"))
    return W.label_transition(r).groupBy("label").agg(F.count("*").alias("n"))


@query("w19_mutation_check", f"""WITH {T}, B AS (SELECT *, first(state) OVER (PARTITION BY stream_id, candidate_id, generation ORDER BY ts, observation_id ROWS UNBOUNDED PRECEDING) AS baseline FROM T)
  SELECT observation_id, state, baseline FROM B WHERE event = 'VALIDATION_REJECTED' AND state IS DISTINCT FROM baseline""")
def w19(spark, sf):
    e = trace(spark, sf).withColumn("outcome", F.when(F.col("event") == "VALIDATION_REJECTED", "rejected"))
    return W.mutation_check(e).select("observation_id", "state", "baseline")


@query("w20_transient_landing", f"""WITH {T}, P AS (SELECT observation_id, stream_id, epoch_us(ts) AS us, state, lag(state) OVER ({ORD}) AS prev, score FROM T)
  SELECT a.observation_id, coalesce(a.score < 70 AND EXISTS (SELECT 1 FROM P b WHERE b.stream_id = a.stream_id AND b.us > a.us AND b.us <= a.us + 90000000000 AND b.state = a.prev), false) AS transient FROM P a""")
def w20(spark, sf):
    e = trace(spark, sf).withColumn("state_key", F.col("state")).withColumn("previous_key", F.lag("state").over(W.along()))
    return W.transient_landing(e, seconds=90000).select("observation_id", F.coalesce("transient", F.lit(False)).alias("transient"))


@query("t1_chronological", f"WITH {E} SELECT stream_id, observation_id, row_number() OVER ({ORD}) AS place FROM E")
def t1(spark, sf):
    return W.chronological(events(spark, sf)).select("stream_id", "observation_id", F.row_number().over(W.along()).cast("long").alias("place"))


@query("t2_top_candidates", f"WITH {T}, R AS (SELECT stream_id, observation_id, score, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, observation_id) AS r FROM T) SELECT stream_id, observation_id AS candidate, score, CAST(r AS INT) AS rank FROM R WHERE r <= 3")
def t2(spark, sf):
    return W.top_candidates(trace(spark, sf).select("stream_id", F.col("observation_id").alias("candidate"), "score"), 3, "stream_id")


FREQ = """S AS (SELECT user_id AS stream_id, event_id AS seq, [CAST(json_extract(props, '$.k') AS BIGINT) % 50, event_id % 50] AS ids FROM events),
  P AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) AS place, ids FROM S), X AS (SELECT stream_id, place, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS at_ FROM P),
  Q AS (SELECT stream_id, id, count(*) AS n, min((place, at_)) AS f FROM X GROUP BY ALL)"""


def _frequency(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"),
                                          F.array(F.get_json_object("props", "$.k").cast("long") % 50, F.col("event_id") % 50).alias("ids"))
    return W.candidate_frequency(s)


@query("a23_candidate_frequency", f"WITH {FREQ} SELECT stream_id, id, n, CAST(f[1] AS INT) AS place FROM Q")
def a23(spark, sf):
    return _frequency(spark, sf).select("stream_id", "id", "n", F.col("first.place").alias("place"))


@query("t4_candidate_shortlist", f"WITH {FREQ}, R AS (SELECT stream_id, id, row_number() OVER (PARTITION BY stream_id ORDER BY f, n DESC, id) AS r FROM Q) SELECT stream_id, id, CAST(r AS INT) AS rank FROM R WHERE r <= 8")
def t4(spark, sf):
    return W.candidate_shortlist(_frequency(spark, sf), 8).select("stream_id", "id", "rank")


@query("t5_resolve_identity", f"""WITH {FREQ}, D AS (SELECT Q.*, CASE WHEN id % 3 = 0 THEN '2024.01.02' WHEN id % 3 = 1 THEN '2023-05-06' END AS date FROM Q WHERE id % 2 = 0),
  R AS (SELECT stream_id, id, row_number() OVER (PARTITION BY stream_id ORDER BY regexp_replace(coalesce(date, ''), '[^0-9]', '', 'g') DESC, f, n DESC, id) AS r FROM D) SELECT stream_id, id FROM R WHERE r = 1""")
def t5(spark, sf):
    m = _frequency(spark, sf).withColumn("verified", F.col("id") % 2 == 0).withColumn("date", F.when(F.col("id") % 3 == 0, "2024.01.02").when(F.col("id") % 3 == 1, "2023-05-06"))
    return W.resolve_identity(m).select("stream_id", "id")


@query("t6_best_candidate", "SELECT l_orderkey AS observation_id, arg_min(l_partkey, (-l_quantity, l_partkey)) AS candidate, max(l_quantity) AS score FROM lineitem GROUP BY l_orderkey")
def t6(spark, sf):
    return W.best_candidate(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("observation_id"), F.col("l_partkey").alias("candidate"), F.col("l_quantity").alias("score")))


@query("t7_latest_ranked_lines", """SELECT l_suppkey AS state, l_linenumber AS rank, arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS move, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS cp FROM lineitem GROUP BY ALL""")
def t7(spark, sf):
    log = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("state"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("move"), F.lit("").alias("pv"), F.col("l_quantity").alias("cp"),
                                              F.lit(None).cast("int").alias("mate"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("pos"))
    return W.latest_ranked_lines(log).select("state", "rank", "move", "cp")


@query("t8_two_highest_cells", f"""WITH {V}, S AS (SELECT observation_id, cells, list_sort(list_transform(range(0, 64), lambda i: {{'k': -cells[i + 1], 'cell': i}}))[1:2] AS two FROM V)
  SELECT observation_id, CAST(CASE WHEN (two[1].cell * 7) % 64 > (two[2].cell * 7) % 64 THEN two[2].cell ELSE two[1].cell END AS INT) AS source, CAST(CASE WHEN (two[1].cell * 7) % 64 > (two[2].cell * 7) % 64 THEN two[1].cell ELSE two[2].cell END AS INT) AS target,
  round(-two[1].k, 6) AS best, round(-two[2].k, 6) AS second FROM S""")
def t8(spark, sf):
    v = vectors(spark, sf).withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 7 % 64))
    return rounded(W.two_highest_cells(v), digits=6)


@query("t9_ranked_candidates", """WITH R AS (SELECT user_id AS observation_id, event_id AS candidate, value AS score, event_id % 60 AS origin, event_id // 7 % 60 AS target FROM events),
  W AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS margin FROM R WINDOW w AS (PARTITION BY observation_id ORDER BY score DESC, candidate))
  SELECT observation_id, candidate, CAST(r AS INT) AS rank, round(margin, 6) AS margin, CASE WHEN origin >= 25 AND target >= 25 AND origin + target >= 70 THEN 'passed' WHEN origin < 25 AND target < 25 THEN 'absent' ELSE 'ambiguous' END AS decision FROM W WHERE r <= 3""")
def t9(spark, sf):
    c = table(spark, sf, "events").select(F.col("user_id").alias("observation_id"), F.col("event_id").alias("candidate"), F.col("value").alias("score"),
                                          (F.col("event_id") % 60).alias("origin"), (F.floor(F.col("event_id") / 7) % 60).alias("target"))
    return W.ranked_candidates(c, 3).select("observation_id", "candidate", "rank", F.round("margin", 6).alias("margin"), "decision")


@query("j3_lookahead", f"""WITH {E} SELECT observation_id, count(*) OVER w AS n, max(value) OVER w AS most FROM E WINDOW w AS (PARTITION BY stream_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 14400000000 FOLLOWING)""")
def j3(spark, sf):
    return joins.lookahead(events(spark, sf), 14400, {"n": F.count("*"), "most": F.max("value")}).select("observation_id", "n", "most")


@query("j3_lookahead_join", f"""WITH {T} SELECT a.observation_id AS left_id, b.observation_id AS right_id FROM T a JOIN T b ON a.stream_id = b.stream_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + 14400000000
  WHERE a.event = 'CANDIDATE' AND b.event = 'ACCEPT'""")
def j3b(spark, sf):
    t = trace(spark, sf)
    return joins.lookahead_join(t.filter("event = 'CANDIDATE'"), t.filter("event = 'ACCEPT'"), 14400).select(F.col("observation_id").alias("left_id"), F.col("r_observation_id").alias("right_id"))


@query("a22_temporal_support", f"""WITH {E}, P AS (SELECT *, value AS origin, CAST(k AS DOUBLE) AS target FROM E) SELECT observation_id, count(*) OVER w AS samples, count(*) FILTER (origin >= 25 AND target >= 25 AND origin + target >= 70) OVER w AS passes,
  max(origin) OVER w AS most_origin, max(target) OVER w AS most_target, round(max(origin + target) OVER w, 6) AS most_pair, count(*) OVER w >= 2 AND count(*) FILTER (origin >= 25 AND target >= 25 AND origin + target >= 70) OVER w >= 2 AS supported
  FROM P WINDOW w AS (PARTITION BY stream_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING)""")
def a22(spark, sf):
    p = events(spark, sf).withColumn("origin", F.col("value")).withColumn("target", F.col("k").cast("double"))
    return rounded(evidence.temporal_support(p, 86400).select("observation_id", "samples", "passes", "most_origin", "most_target", "most_pair", "supported"), "most_pair", digits=6)


@query("p1_bounded_window", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def p1(spark, sf):
    from obsline.sources.tables import bounded_window

    return bounded_window(table(spark, sf, "events"), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "value")


@query("p8_classify_event", f"""WITH {T} SELECT event, CASE event WHEN 'QUIET' THEN 'detector' WHEN 'CANDIDATE' THEN 'scoring' WHEN 'ACCEPT' THEN 'reducer' WHEN 'REVERT_APPLIED' THEN 'revert' WHEN 'VALIDATION_REJECTED' THEN 'validation' ELSE 'clock' END AS phase,
  CASE event WHEN 'ACCEPT' THEN 'ACCEPT' WHEN 'QUIET' THEN 'INFORMATIONAL' WHEN 'VALIDATION_REJECTED' THEN 'REJECT' WHEN 'REVERT_APPLIED' THEN 'RECOVERING' ELSE 'OBSERVED' END AS outcome,
  CASE event WHEN 'QUIET' THEN 'detector_or_scoring' WHEN 'CANDIDATE' THEN 'detector_or_scoring' WHEN 'ACCEPT' THEN 'reducer' WHEN 'REVERT_APPLIED' THEN 'reducer' ELSE 'detector_or_validation' END AS layer,
  event IN ('ACCEPT', 'VALIDATION_REJECTED', 'REVERT_APPLIED') AS decision, count(*) AS n FROM T GROUP BY ALL""")
def p8(spark, sf):
    t = trace(spark, sf)
    e = F.col("event")
    return t.groupBy("event", rules.classify_event(e)["phase"].alias("phase"), rules.normalize_outcome(F.col("outcome"), e).alias("outcome"), rules.event_layer(e).alias("layer"), rules.is_decision(e).alias("decision")).agg(F.count("*").alias("n"))


@query("p12_p13_gates", """WITH R AS (SELECT l_orderkey, l_linenumber, l_partkey % 60 AS o, l_suppkey % 60 AS t, CAST(floor(l_quantity) AS BIGINT) * 3 AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN o >= 25 AND t >= 25 AND o + t >= 70 THEN 'passed' WHEN o < 25 AND t < 25 THEN 'absent' ELSE 'ambiguous' END AS gate, s >= 60 AND o >= 40 AND t >= 40 AND o + t >= 90 AS hover_override,
  s >= 100 AND o >= 35 AND t >= 35 AND o + t >= 100 AS clock_override, NOT (l_linenumber <= 1 AND (o < 6 OR t < 6)) AS complete FROM R""")
def p12(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).alias("o"), (F.col("l_suppkey") % 60).alias("t"), (F.col("l_quantity").cast("long") * 3).alias("s"))
    o, t, s = F.col("o"), F.col("t"), F.col("s")
    return r.select("l_orderkey", "l_linenumber", rules.highlight_gate(o, t).alias("gate"), rules.strong_registration(s, o, t).alias("hover_override"),
                    rules.strong_registration(s, o, t, "clock").alias("clock_override"), rules.endpoint_complete(F.col("l_linenumber"), o, t).alias("complete"))


@query("p14_quiet_filter", f"""WITH {V}, P AS (SELECT observation_id, cells, lag(cells) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM V), D AS (SELECT observation_id, list_transform(range(1, 65), lambda i: abs(cells[i] - b[i])) AS d FROM P WHERE b IS NOT NULL)
  SELECT observation_id, list_max(d) < 15 AS quiet, len(list_filter(d, lambda x: x >= 15)) AS changed FROM D""")
def p14(spark, sf):
    from pyspark.sql import Window

    p = vectors(spark, sf).withColumn("b", F.lag("cells").over(Window.partitionBy("stream_id").orderBy("seq"))).filter("b IS NOT NULL")
    return p.select("observation_id", rules.quiet_filter(F.col("cells"), F.col("b")).alias("quiet"), F.size(rules.changed_cells(F.col("cells"), F.col("b"))).cast("long").alias("changed"))


@query("f1_f6_readings", """WITH R AS (SELECT o_orderkey, printf('%d:%02d:%02d', o_orderkey % 3, o_orderkey % 60, (o_orderkey * 7) % 60) AS r FROM orders)
  SELECT o_orderkey, CAST(o_orderkey % 3 * 3600 + o_orderkey % 60 * 60 + (o_orderkey * 7) % 60 AS INT) AS seconds, r AS normal, replace(r, ':', '') AS digits,
  printf('%02d:%02d:%02d,000', o_orderkey % 3, o_orderkey % 60, (o_orderkey * 7) % 60) AS cue FROM R""")
def f1(spark, sf):
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(k, F.format_string("%d::%02d:%02d", k % 3, k % 60, (k * 7) % 60).alias("r"))
    plain = F.replace("r", F.lit("::"), F.lit(":"))
    return r.select("o_orderkey", scalars.reading_seconds(plain).alias("seconds"), scalars.normal_reading(F.col("r")).alias("normal"), scalars.digits(F.col("r")).alias("digits"),
                    scalars.cue_time(scalars.reading_seconds(plain).cast("double")).alias("cue"))


@query("f14_f17_scores", """WITH R AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INT) * 40 - 1000 AS cp, CASE WHEN l_partkey % 10 = 0 THEN CAST(l_suppkey % 9 AS INT) - 4 END AS mate, CAST(l_partkey % 80 AS DOUBLE) AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN mate IS NULL THEN cp WHEN mate > 0 THEN 10000 - mate ELSE -10000 - mate END AS line_score, round(1 / (1 + exp(-0.00368208 * cp)), 9) AS win,
  round(CASE WHEN s >= 60 THEN 99.9 WHEN s <= 0 THEN 0 WHEN s >= 25 THEN 50 + (s - 25) / 35 * 49.9 ELSE s / 25 * 50 END, 9) AS confidence FROM R""")
def f14(spark, sf):
    cp, mate, s = F.col("l_quantity").cast("int") * 40 - 1000, F.when(F.col("l_partkey") % 10 == 0, (F.col("l_suppkey") % 9).cast("int") - 4), (F.col("l_partkey") % 80).cast("double")
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cp.alias("cp"), mate.alias("mate"), s.alias("s"))
    return rounded(r.select("l_orderkey", "l_linenumber", scalars.line_score(F.col("cp"), F.col("mate")).alias("line_score"), scalars.win_probability(F.col("cp")).alias("win"), scalars.score_confidence(F.col("s")).alias("confidence")))


@query("f27_f28_keys", f"""WITH {V}, Q AS (SELECT observation_id, list_transform([[0, 0], [0, 4], [4, 0], [4, 4]], lambda o: list_sum(list_transform(range(0, 16), lambda i: cells[(o[1] + i // 4) * 8 + o[2] + i % 4 + 1])) / 16) AS q FROM V0),
  B AS (SELECT observation_id, list_transform(q, lambda m: least(greatest(CAST(floor(m / 8 + 0.5) AS BIGINT), 0), 63)) AS b FROM Q)
  SELECT observation_id, b[1] * 262144 + b[2] * 4096 + b[3] * 64 + b[4] AS key, (observation_id % 7) * 4294967296 + observation_id AS packed FROM B""")
def f27(spark, sf):
    v = vectors(spark, sf).filter("NOT moved")
    return v.select("observation_id", scalars.pack_buckets([scalars.bucket_of(q) for q in scalars.quadrants(F.col("cells"))]).alias("key"), scalars.pack_id(F.col("observation_id") % 7, F.col("observation_id")).alias("packed"))


@query("f8_f9_states", f"WITH {G} SELECT stream_id, seq, split_part(state, ' ', 1) || ' ' || split_part(state, ' ', 2) || ' - -' AS key, split_part(state, ' ', 2) AS side FROM G")
def f8(spark, sf):
    return game(spark, sf).select("stream_id", "seq", scalars.state_key(F.col("state")).alias("key"), scalars.side_to_move(F.col("state")).alias("side"))
