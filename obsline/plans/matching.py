"""Queries for joins J1-J24, sets U1-U7, branches, evidence A11-A35 and checks V1-V8."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsline.operators import branches as B
from obsline.operators import evidence as X
from obsline.operators import joins as J
from obsline.operators import verify as C
from obsline.plans.base import ORD, E, G, T, V, events, game, query, rounded, table, trace, vectors


def two_runs(spark, sf):
    """A trace and a changed copy of it: rows dropped, states changed, ids moved."""
    a = trace(spark, sf)
    b = a.filter("observation_id % 101 <> 0").withColumn("state", F.when(F.col("observation_id") % 53 == 0, "changed").otherwise(F.col("state"))).withColumn(
        "observation_id", F.when(F.col("observation_id") % 211 == 0, F.col("observation_id") + 10_000_000).otherwise(F.col("observation_id")))
    return a, b


RUNS = T + """, B AS (SELECT * REPLACE (CASE WHEN observation_id % 53 = 0 THEN 'changed' ELSE state END AS state, CASE WHEN observation_id % 211 = 0 THEN observation_id + 10000000 ELSE observation_id END AS observation_id)
  FROM T WHERE observation_id % 101 <> 0)"""


@query("j1_compare_by_id", f"""WITH {RUNS} SELECT coalesce(T.stream_id, B.stream_id) AS stream_id, coalesce(T.observation_id, B.observation_id) AS observation_id,
  CASE WHEN B.stream_id IS NULL THEN 'missing' WHEN T.stream_id IS NULL THEN 'unexpected' ELSE 'field:state' END AS finding
  FROM T FULL JOIN B ON T.stream_id = B.stream_id AND T.observation_id = B.observation_id WHERE B.stream_id IS NULL OR T.stream_id IS NULL OR T.state <> B.state""")
def j1(spark, sf):
    a, b = (d.withColumn("cells", F.array("value")).withColumn("events", F.array("event")) for d in two_runs(spark, sf))
    return J.compare_by_id(a, b, ["state"])


@query("j2_compare_by_position", f"""WITH {RUNS}, A1 AS (SELECT stream_id, row_number() OVER ({ORD}) - 1 AS position, state AS expected FROM T), B1 AS (SELECT stream_id, row_number() OVER ({ORD}) - 1 AS position, state AS actual FROM B),
  M AS (SELECT coalesce(A1.stream_id, B1.stream_id) AS stream_id, coalesce(A1.position, B1.position) AS position, expected, actual FROM A1 FULL JOIN B1 ON A1.stream_id = B1.stream_id AND A1.position = B1.position WHERE expected IS DISTINCT FROM actual)
  SELECT stream_id, CAST(min(position) AS INT) AS position, arg_min(coalesce(expected, '-'), position) AS expected, arg_min(coalesce(actual, '-'), position) AS actual FROM M GROUP BY stream_id""")
def j2(spark, sf):
    found = J.compare_by_position(*two_runs(spark, sf), "state", first_only=True)
    return found.select("stream_id", "position", F.coalesce("expected", F.lit("-")).alias("expected"), F.coalesce("actual", F.lit("-")).alias("actual"))


_SIM = """SELECT a.stream_id, a.observation_id, a.seq, b.seq AS h_seq, list_max(list_transform(range(1, 65), lambda i: abs(a.cells[i] - b.cells[i]))) AS m,
  list_sum(list_transform(range(1, 65), lambda i: abs(a.cells[i] - b.cells[i]))) / 64 AS diff FROM V a JOIN V b ON a.stream_id = b.stream_id AND b.seq < a.seq - 1"""


@query("j4_similar_state_join", f"""WITH {V}, P AS ({_SIM}), R AS (SELECT *, row_number() OVER (PARTITION BY stream_id, observation_id ORDER BY diff, h_seq DESC) AS r FROM P WHERE m < 15 AND diff < 3.5)
  SELECT stream_id, observation_id, h_seq, round(diff, 6) AS diff FROM R WHERE r = 1""")
def j4(spark, sf):
    v = vectors(spark, sf)
    return rounded(J.similar_state_join(v, v, radius=2).select("stream_id", "observation_id", "h_seq", "diff"), digits=6)


@query("j5_similar_state_exhaustive", f"""WITH {V}, P AS ({_SIM}), R AS (SELECT *, row_number() OVER (PARTITION BY stream_id, observation_id ORDER BY h_seq DESC) AS r FROM P WHERE m < 15 AND diff < 3.5)
  SELECT stream_id, observation_id, h_seq, round(diff, 6) AS diff FROM R WHERE r = 1""")
def j5(spark, sf):
    v = vectors(spark, sf)
    return rounded(J.similar_state_exhaustive(v, v, mode="most_recent").select("stream_id", "observation_id", "h_seq", "diff"), digits=6)


@query("j6_nearest_in_time", f"""WITH RECURSIVE {T}, A AS (SELECT stream_id, state AS transition, observation_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY stream_id, state ORDER BY ts, observation_id) AS k FROM T WHERE side = 'w'),
  D AS (SELECT stream_id, state AS transition, list({{'us': epoch_us(ts), 'id': observation_id}} ORDER BY ts, observation_id) AS free FROM T WHERE side = 'b' GROUP BY ALL),
  P(stream_id, transition, k, observation_id, us, free, hit) AS (SELECT A.stream_id, A.transition, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), coalesce(any_value(D.free), []), CAST(NULL AS STRUCT(d BIGINT, us BIGINT, id BIGINT))
    FROM A LEFT JOIN D ON D.stream_id = A.stream_id AND D.transition = A.transition GROUP BY ALL
    UNION ALL SELECT stream_id, transition, k, observation_id, us, list_filter(free, lambda x: hit IS NULL OR x.id <> hit.id), hit FROM (SELECT A.stream_id, A.transition, A.k, A.observation_id, A.us, P.free,
    list_min(list_transform(P.free, lambda x: {{'d': abs(x.us - A.us), 'us': x.us, 'id': x.id}})) AS hit FROM P JOIN A ON A.stream_id = P.stream_id AND A.transition = P.transition AND A.k = P.k + 1))
  SELECT observation_id, round(hit.d / 1000000, 3) AS distance, hit.id AS d_id FROM P WHERE k > 0""")
def j6(spark, sf):
    t = trace(spark, sf).withColumn("transition", F.col("state"))
    return rounded(J.nearest_in_time(t.filter("side = 'w'"), t.filter("side = 'b'")).select("observation_id", "distance", "d_id"), digits=3)


@query("j7_state_key_join", f"""WITH {G}, K AS (SELECT *, split_part(state, ' ', 1) || ' ' || split_part(state, ' ', 2) AS key FROM G) SELECT a.stream_id, a.seq, b.seq AS r_seq FROM K a JOIN K b ON a.stream_id = b.stream_id AND a.key = b.key AND b.seq < a.seq""")
def j7(spark, sf):
    g = game(spark, sf).select("stream_id", "seq", "state")
    return J.state_key_join(g, g).filter("r_seq < seq").select("stream_id", "seq", "r_seq")


@query("j8_missing_and_known", f"""WITH {RUNS} SELECT T.observation_id, 'missing' AS kind FROM T WHERE NOT EXISTS (SELECT 1 FROM B WHERE B.observation_id = T.observation_id)
  UNION ALL SELECT T.observation_id, 'known' FROM T WHERE EXISTS (SELECT 1 FROM B WHERE B.observation_id = T.observation_id)""")
def j8(spark, sf):
    a, b = two_runs(spark, sf)
    key = ["observation_id"]
    return J.missing_in(a, b, key).select("observation_id", F.lit("missing").alias("kind")).unionByName(J.known_in(a, b, key).select("observation_id", F.lit("known").alias("kind")))


@query("j10_contains_sequence", f"""WITH {G}, K AS (SELECT stream_id, seq, move FROM G), O AS (SELECT * FROM K WHERE seq < 2), S AS (SELECT stream_id, count(*) AS size FROM O GROUP BY stream_id),
  H AS (SELECT O.stream_id, K.stream_id AS game_id, K.seq - O.seq AS start, count(*) AS n FROM K JOIN O ON K.move = O.move GROUP BY ALL) SELECT H.stream_id, game_id, start FROM H JOIN S ON S.stream_id = H.stream_id AND n = size WHERE start >= 0""")
def j10(spark, sf):
    g = game(spark, sf).select("stream_id", F.col("seq").alias("pos"), F.col("move").alias("key"))
    return J.contains_sequence(g.withColumnRenamed("stream_id", "game_id"), g.filter("pos < 2"))


@query("j11_keyword_match", """SELECT page_id, CASE WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), 'example.net') OR contains(lower(url), '/fr/') THEN 'net' WHEN contains(lower(url), 'm.') THEN 'mobile' ELSE 'generic' END AS template FROM pages""")
def j11(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.col("url").alias("name"))
    return J.keyword_match(names, [("blog", ["blog"]), ("net", ["example.net", "/fr/"]), ("mobile", ["m."])], "generic").select("page_id", "template")


@query("j12_lookup_enrich", f"""WITH {T}, K AS (SELECT T.*, p_name AS name, p_brand AS code FROM T LEFT JOIN part ON p_partkey = k * 37 - 9)
  SELECT observation_id, last_value(code IGNORE NULLS) OVER w AS code, last_value(name IGNORE NULLS) OVER w AS name FROM K WINDOW w AS (PARTITION BY stream_id ORDER BY observation_id ROWS UNBOUNDED PRECEDING)""")
def j12(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("state_key"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"))
    t = events(spark, sf).select("stream_id", "observation_id", F.col("observation_id").alias("seq"), (F.col("k") * 37 - 9).cast("long").alias("state_key"))  # not all are parts
    return J.lookup_enrich(t, p).select("observation_id", "code", "name")


@query("j13_before_after", f"""WITH {E}, K AS (SELECT E.*, CAST(floor(p_retailprice) AS BIGINT) AS cp FROM E LEFT JOIN part ON p_partkey = k + 1) SELECT observation_id, cp AS cp_before, lead(cp) OVER (PARTITION BY stream_id ORDER BY observation_id) AS cp_after FROM K""")
def j13(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("state_key"), F.lit(1).alias("rank"), F.col("p_retailprice").cast("long").alias("cp"), F.col("p_brand").alias("move"))
    t = events(spark, sf).select("stream_id", "observation_id", F.col("observation_id").alias("seq"), (F.col("k") + 1).cast("long").alias("state_key"))
    return J.before_after_evaluation(t, v).select("observation_id", "cp_before", "cp_after")


@query("j14_score_candidates", f"""WITH {V}, C AS (SELECT observation_id, cells, unnest([0, 1, 2]) AS c FROM V0), S AS (SELECT observation_id, c, CASE c WHEN 0 THEN cells[observation_id % 60 + 1] + cells[observation_id % 60 + 2] WHEN 1 THEN cells[1] + cells[2] + cells[3] - 10
  ELSE cells[5] + cells[6] + cells[7] + cells[8] - 20 END AS s FROM C) SELECT observation_id, 'c' || CAST(c AS VARCHAR) AS candidate, round(s, 6) AS score FROM S""")
def j14(spark, sf):
    v = vectors(spark, sf).filter("NOT moved")
    i = (F.col("observation_id") % 60).cast("int")
    c = v.select("observation_id", F.inline(F.array(F.struct(F.lit("c0").alias("candidate"), F.array(i, i + 1).alias("squares")), F.struct(F.lit("c1").alias("candidate"), F.array(*map(F.lit, (0, 1, 2))).alias("squares")),
                                                    F.struct(F.lit("c2").alias("candidate"), F.array(*map(F.lit, (4, 5, 6, 7))).alias("squares")))))
    return rounded(J.score_candidates(v, c), digits=6)


@query("j16_missing_artifacts", f"""WITH {E}, P AS (SELECT observation_id, CASE WHEN k % 5 = 0 THEN '' ELSE 'f' || CAST(k AS VARCHAR) END AS a, CASE WHEN k % 7 = 0 THEN '' ELSE 'g' || CAST(k AS VARCHAR) END AS b FROM E)
  SELECT observation_id, 'a' AS artifact, 'missing' AS finding FROM P WHERE a <> '' AND CAST(substr(a, 2) AS INT) >= 60 UNION ALL SELECT observation_id, 'b', 'missing' FROM P WHERE b <> '' AND CAST(substr(b, 2) AS INT) >= 60
  UNION ALL SELECT observation_id, 'a|b', 'unpaired' FROM P WHERE (a = '') <> (b = '')""")
def j16(spark, sf):
    e = events(spark, sf)
    k = F.col("k").cast("string")
    r = e.select("observation_id", F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("f"), k)).alias("a"), F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("g"), k)).alias("b"))
    there = e.filter("k < 60").select(F.concat(F.lit("f"), k).alias("path")).unionByName(e.filter("k < 60").select(F.concat(F.lit("g"), k).alias("path")))
    return J.missing_artifacts(r, there, ["a", "b"], [("a", "b")])


@query("j17_multiset_delta", f"""WITH {RUNS}, D AS (SELECT coalesce(x.state, y.state) AS state, coalesce(b, 0) - coalesce(a, 0) AS d FROM (SELECT state, count(*) AS a FROM T GROUP BY state) x FULL JOIN (SELECT state, count(*) AS b FROM B GROUP BY state) y ON x.state = y.state)
  SELECT state, greatest(-d, 0) AS missing, greatest(d, 0) AS extra FROM D WHERE d <> 0""")
def j17(spark, sf):
    return J.multiset_delta(*two_runs(spark, sf), ["state"])


REPORTS = """Q AS (SELECT o_orderkey AS report_id, o_custkey // 10 AS stream_id, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 28) DAY AS start, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 28 + 1) DAY AS stop, 'm' || CAST(o_orderkey % 5 AS VARCHAR) AS move FROM orders)"""


def reports(spark, sf):
    """Every order as a report on one day of a stream; ten customers share a stream."""
    day = F.lit("2024-01-01").cast("timestamp")
    o = table(spark, sf, "orders")
    at = F.unix_micros(day) + (F.col("o_orderkey") % 28) * 86_400_000_000
    return o.select(F.col("o_orderkey").alias("report_id"), F.floor(F.col("o_custkey") / 10).alias("stream_id"), F.timestamp_micros(at).cast("timestamp_ntz").alias("start"),
                    F.timestamp_micros(at + 86_400_000_000).cast("timestamp_ntz").alias("stop"), F.concat(F.lit("m"), (F.col("o_orderkey") % 5).cast("string")).alias("move"))


@query("j20_decision_interval", f"WITH {E}, {REPORTS} SELECT report_id, observation_id FROM E JOIN Q ON E.stream_id = Q.stream_id AND ts BETWEEN start AND stop")
def j20(spark, sf):
    return J.decision_interval(events(spark, sf), reports(spark, sf).drop("move")).select("report_id", "observation_id")


@query("j21_rank_history_sources", f"""WITH {E}, H AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY observation_id) AS n FROM E),
  S AS (SELECT a.stream_id, a.observation_id, b.observation_id AS source_seq, a.value + 4 * (a.k - b.observation_id % 50) AS quality FROM H a JOIN H b ON a.stream_id = b.stream_id AND b.n BETWEEN a.n - 64 AND a.n - 1),
  R AS (SELECT *, row_number() OVER (PARTITION BY stream_id, observation_id ORDER BY round(quality, 6) DESC, source_seq DESC) AS r FROM S) SELECT observation_id, source_seq, round(quality, 6) AS quality FROM R WHERE r = 1""")
def j21(spark, sf):
    e = events(spark, sf)
    seen = e.select("stream_id", "observation_id", F.col("observation_id").alias("seq"), F.col("value").alias("score"), F.col("k").cast("double").alias("active_diff"))
    h = e.select("stream_id", F.col("observation_id").alias("seq"), (F.col("observation_id") % 50).cast("double").alias("source_diff"))
    return rounded(J.rank_history_sources(seen, h).select("observation_id", "source_seq", "quality"), digits=6)


@query("j22_best_earlier_reading", f"""WITH {E}, R AS (SELECT *, CASE WHEN k % 3 > 0 THEN seconds END AS reading FROM E),
  F AS (SELECT b.observation_id, arg_min(a.reading, (abs(a.k - b.k), -a.observation_id)) AS found FROM R a JOIN R b ON a.stream_id = b.stream_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + 86400000000
  WHERE a.reading IS NOT NULL AND b.reading IS NULL AND abs(a.k - b.k) <= 20 GROUP BY b.observation_id), W AS (SELECT *, last_value(reading IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM R)
  SELECT W.observation_id, coalesce(reading, found, CASE WHEN abs(300 - last) <= 180 THEN 300 END) AS resolved FROM W LEFT JOIN F ON F.observation_id = W.observation_id""")
def j22(spark, sf):
    e = events(spark, sf).select("stream_id", "observation_id", "ts", F.when(F.col("k") % 3 > 0, F.col("seconds")).alias("reading"), F.array(F.col("k").cast("double")).alias("cells"), F.lit(300).alias("retained"))
    return J.best_earlier_reading(e, 86400).select("observation_id", "resolved")


@query("j24_transposition_edges", f"""WITH {G}, N AS (SELECT stream_id, move AS transition, split_part(state, ' ', 2) AS parent_key, lead(split_part(state, ' ', 2)) OVER (PARTITION BY stream_id ORDER BY seq) AS child_key FROM G),
  D AS (SELECT DISTINCT * FROM N WHERE child_key IS NOT NULL) SELECT N.stream_id, N.transition, N.child_key AS state_key, D.parent_key, count(*) AS n FROM N JOIN D ON N.stream_id = D.stream_id AND N.transition = D.transition AND N.child_key = D.child_key GROUP BY ALL""")
def j24(spark, sf):
    g = game(spark, sf).withColumn("parent_key", F.split("state", " ")[1])
    e = g.select("stream_id", F.col("move").alias("transition"), "parent_key", F.lead("parent_key").over(Window.partitionBy("stream_id").orderBy("seq")).alias("child_key")).filter("child_key IS NOT NULL")
    m = e.select("stream_id", "transition", F.col("child_key").alias("state_key"))
    return J.transposition_edges(e, m).groupBy("stream_id", "transition", "state_key", "parent_key").agg(F.count("*").alias("n"))


@query("a19_reconcile_readings", f"""WITH {E}, R AS (SELECT observation_id // 3 AS oid, CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k % 3 AS VARCHAR) END AS reading, CASE WHEN (observation_id // 3) % 4 = 0 THEN 'old' END AS inh FROM E),
  C AS (SELECT oid, reading, count(*) AS c, max(inh) AS inh FROM R GROUP BY oid, reading), S AS (SELECT oid, CAST(sum(c) AS BIGINT) AS samples, CAST(coalesce(sum(c) FILTER (reading IS NOT NULL), 0) AS BIGINT) AS observed, count(reading) AS kinds,
  max(c) FILTER (reading IS NOT NULL) AS top, max(inh) AS inh FROM C GROUP BY oid), Y AS (SELECT S.*, (SELECT count(*) FROM C WHERE C.oid = S.oid AND reading IS NOT NULL AND c = top) AS ties, (SELECT max(reading) FROM C WHERE C.oid = S.oid AND c = top AND reading IS NOT NULL) AS best FROM S),
  P AS (SELECT *, CASE WHEN kinds = 0 AND inh IS NOT NULL THEN 'inherited' WHEN kinds = 0 THEN 'missing' WHEN kinds = 1 AND samples = 1 THEN 'direct' WHEN ties = 1 AND top >= 2 THEN 'temporally_plausible' ELSE 'rejected' END AS provenance FROM Y)
  SELECT oid AS observation_id, samples, observed, provenance, CASE WHEN provenance = 'inherited' THEN inh WHEN provenance IN ('direct', 'temporally_plausible') THEN best END AS selected FROM P""")
def a19(spark, sf):
    oid = F.floor(F.col("observation_id") / 3)
    r = events(spark, sf).select(oid.alias("observation_id"), F.when(F.col("k") % 6 == 0, "").otherwise((F.col("k") % 3).cast("string")).alias("reading"), F.when(oid % 4 == 0, "old").alias("inherited"))
    return X.reconcile_readings(r)


@query("a20_loss_and_accuracy", """WITH R AS (SELECT l_suppkey AS stream_id, CASE WHEN l_linenumber % 2 = 1 THEN 'w' ELSE 'b' END AS side, least(greatest(CAST(floor(l_quantity) AS BIGINT) * 30 - 100, 0), 1000) AS c FROM lineitem),
  A AS (SELECT stream_id, side, count(*) AS n, avg(c) AS a FROM R GROUP BY ALL) SELECT stream_id, side, n, round(a, 6) AS acpl, round(100 * exp(-0.007 * a), 6) AS accuracy, CAST(least(greatest(floor(3000 - 200 - a * 12), 100), 3000) AS INT) AS rating FROM A""")
def a20(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stream_id"), F.when(F.col("l_linenumber") % 2 == 1, "w").otherwise("b").alias("side"), (F.col("l_quantity").cast("long") * 30 - 100).alias("loss"))
    return rounded(X.loss_and_accuracy(r), digits=6)


@query("a21_compact_observations", f"""WITH {T} SELECT stream_id, CAST(candidate_id AS BIGINT) AS observation_key, arg_min(state, (sequence, ts, event)) AS state, array_to_string(list(event ORDER BY sequence), ',') AS events FROM T GROUP BY ALL""")
def a21(spark, sf):
    t = trace(spark, sf).withColumn("observation_id", F.col("candidate_id").cast("long"))
    c = X.compact_observations(t, ["state"], ["event"])
    return c.select("stream_id", "observation_key", "state", F.array_join(F.transform("events", lambda x: x["event"]), ",").alias("events"))


@query("a24_repeated_rejections", f"""WITH {T}, P AS (SELECT stream_id, candidate_id, count(*) AS c, list(DISTINCT move) AS m FROM T WHERE event = 'VALIDATION_REJECTED' GROUP BY ALL HAVING count(*) > 1)
  SELECT stream_id, count(*) AS candidates, CAST(sum(c - 1) AS BIGINT) AS repeated, array_to_string(list_sort(list_distinct(flatten(list(m)))), ',') AS reasons FROM P GROUP BY stream_id""")
def a24(spark, sf):
    t = trace(spark, sf).withColumn("outcome", F.when(F.col("event") == "VALIDATION_REJECTED", "rejected")).withColumn("reason", F.col("move"))
    return X.repeated_rejections(t).withColumn("reasons", F.array_join("reasons", ","))


@query("a11_quality_report", f"""WITH {T} SELECT stream_id, count(*) AS records, count(DISTINCT candidate_id) AS candidates, count(*) FILTER (event = 'ACCEPT') AS outcome_accept, count(*) FILTER (event = 'VALIDATION_REJECTED') AS outcome_reject,
  count(*) FILTER (event = 'REVERT_APPLIED') AS outcome_recovering, count(*) FILTER (event = 'QUIET') AS event_quiet, min(score) AS score_min, max(score) AS score_max, round(avg(score), 4) AS score_mean, count(*) FILTER (k < 10) AS low_margin FROM T GROUP BY stream_id""")
def a11(spark, sf):
    t = trace(spark, sf).withColumn("reason", F.lit("")).withColumn("margin", F.col("k").cast("double"))
    r = X.detector_quality_report(t, "stream_id")
    return rounded(r.select("stream_id", "records", "candidates", "outcome_accept", "outcome_reject", "outcome_recovering", "event_quiet", "score_min", "score_max", "score_mean", "low_margin"), "score_mean", digits=4)


def evidence_trace(spark, sf):
    t = trace(spark, sf)
    k = F.col("k")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), k % len(names))
    squares = F.when(k % 4 > 0, F.array(F.lit("e2"), F.lit("e4")))
    return t.withColumn("evidence", F.struct(
        F.when(k % 4 == 1, 2).when(k % 4 == 2, 3).cast("long").alias("changed_square_count"), squares.alias("changed_squares"),
        F.lit(None).cast("string").alias("yellow_strength"), (k % 2 == 0).alias("yellow_checked"), pick("", "passed", "ambiguous", "no_highlight", "passed_temporal").alias("yellow_decision"),
        F.lit(None).cast("string").alias("clock_strength"), (k % 3 == 0).alias("clock_checked"), pick("", "turn_match", "turn_mismatch", "ocr_missing").alias("clock_decision"),
        F.when(k % 9 == 0, "advisory").alias("hover_strength"), F.lit(False).alias("hover_checked"), pick("", "clear", "detected", "conflicting").alias("hover_decision"),
        (k % 5 == 0).alias("yellow_temporal_checked"), pick("", "stable", "ambiguous", "other", "passed", "").alias("settle_decision")))


STRONG = T + """, S AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'missing' WHEN k % 4 = 1 OR k % 4 = 3 THEN 'strong' ELSE 'weak' END AS board_difference,
  CASE WHEN k % 2 = 1 AND k % 5 = 0 THEN 'missing' WHEN k % 5 = 2 THEN 'conflicting' WHEN k % 5 = 3 THEN 'missing' WHEN k % 5 = 1 THEN 'strong' ELSE 'weak' END AS highlights,
  CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'missing' WHEN k % 4 = 2 THEN 'conflicting' WHEN k % 4 = 3 THEN 'missing' WHEN k % 4 = 1 THEN 'strong' ELSE 'weak' END AS clocks,
  CASE WHEN k % 5 <> 0 AND k % 6 IN (0, 5) THEN 'missing' WHEN k % 6 = 2 THEN 'conflicting' WHEN k % 6 IN (1, 4) THEN 'strong' ELSE 'weak' END AS temporal_stability,
  CASE WHEN k % 9 = 0 THEN 'advisory' WHEN k % 4 = 0 THEN 'missing' WHEN k % 4 = 3 THEN 'conflicting' WHEN k % 4 = 2 THEN 'weak' ELSE 'strong' END AS hover_state FROM T)"""


@query("a12_strength_summary", f"""WITH {STRONG}, U AS (UNPIVOT (SELECT observation_id, board_difference, highlights, clocks, temporal_stability, hover_state FROM S) ON board_difference, highlights, clocks, temporal_stability, hover_state INTO NAME family VALUE state)
  SELECT family, count(*) FILTER (state = 'strong') AS strong, count(*) FILTER (state = 'weak') AS weak, count(*) FILTER (state = 'advisory') AS advisory, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'conflicting') AS conflicting FROM U GROUP BY family""")
def a12(spark, sf):
    return X.strength_summary(evidence_trace(spark, sf))


_ANY = "'{0}' IN (board_difference, highlights, clocks, temporal_stability, hover_state)"


@query("a13_uncertainty_summary", f"""WITH {STRONG} SELECT stream_id, count(*) AS records, CAST(0 AS BIGINT) AS ambiguous, CAST(0 AS BIGINT) AS waiting, count(*) FILTER ({_ANY.format('weak')}) AS weak_records,
  count(*) FILTER ({_ANY.format('missing')}) AS missing_records, count(*) FILTER ({_ANY.format('conflicting')}) AS conflicting_records FROM S GROUP BY stream_id""")
def a13(spark, sf):
    return X.uncertainty_summary(evidence_trace(spark, sf), "stream_id")


@query("p10_weak_acceptances", f"""WITH {STRONG} SELECT observation_id FROM S WHERE event = 'ACCEPT' AND ({_ANY.format('weak')} OR {_ANY.format('missing')} OR {_ANY.format('conflicting')} OR {_ANY.format('advisory')})""")
def p10(spark, sf):
    return X.weak_acceptances(evidence_trace(spark, sf)).select("observation_id")


_JOINED = f"""WITH {T}, {REPORTS}, F AS (SELECT report_id, count(observation_id) AS n, count(*) FILTER (T.move = Q.move) AS c, count(*) FILTER (T.move = Q.move AND event = 'VALIDATION_REJECTED') AS r,
  count(*) FILTER (T.move = Q.move AND event = 'ACCEPT') AS a, count(*) FILTER (event = 'REVERT_APPLIED') AS v, count(*) FILTER (event = 'ACCEPT') AS x FROM Q LEFT JOIN T ON T.stream_id = Q.stream_id AND ts BETWEEN start AND stop GROUP BY report_id)"""


@query("a29_diagnose_divergence", _JOINED + """ SELECT report_id, CASE WHEN n = 0 THEN 'no_observation' WHEN c = 0 THEN 'no_candidate' WHEN r > 0 THEN 'rejected' WHEN v > 0 THEN 'rolled_back' WHEN x > 0 THEN 'accepted_elsewhere' ELSE 'unknown' END AS cause FROM F""")
def a29(spark, sf):
    return X.diagnose_divergence(trace(spark, sf).withColumn("best_move", F.col("move")), reports(spark, sf)).select("report_id", "cause")


@query("a30_expected_status", _JOINED + """ SELECT report_id AS expected_id, CASE WHEN a > 0 THEN 'accepted' WHEN r > 0 THEN 'rejected' WHEN c > 0 THEN 'observed' WHEN n > 0 THEN 'other_activity' ELSE 'no_evidence' END AS status FROM F""")
def a30(spark, sf):
    t = trace(spark, sf).withColumn("best_move", F.col("move")).withColumn("outcome", F.when(F.col("event") == "ACCEPT", "accepted").when(F.col("event") == "VALIDATION_REJECTED", "rejected"))
    return X.expected_status(t, reports(spark, sf).withColumnRenamed("report_id", "expected_id"))


@query("u_sets", f"""WITH {RUNS}, H AS (SELECT observation_id FROM T INTERSECT SELECT observation_id FROM B), M AS (SELECT observation_id FROM T EXCEPT SELECT observation_id FROM B)
  SELECT 'shared' AS kind, observation_id FROM H UNION ALL SELECT 'missing', observation_id FROM M UNION ALL SELECT 'first', min(observation_id) FROM T GROUP BY stream_id, state""")
def u(spark, sf):
    a, b = two_runs(spark, sf)
    first = X.distinct_states(a.withColumn("seq", F.col("observation_id"))).select(F.lit("first").alias("kind"), F.col("first_seq").alias("observation_id"))
    return X.shared_ids(a, b).select(F.lit("shared").alias("kind"), "observation_id").unionByName(
        X.set_missing(a.select("observation_id"), b.select("observation_id")).select(F.lit("missing").alias("kind"), "observation_id")).unionByName(first)


@query("u1_durable_union", f"WITH {T} SELECT CASE WHEN event = 'ACCEPT' THEN 'main' ELSE 'branch' END AS origin, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM T WHERE event IN ('ACCEPT', 'CANDIDATE') GROUP BY ALL")
def u1(spark, sf):
    t = trace(spark, sf)
    return X.durable_union(t.filter("event = 'ACCEPT'"), t.filter("event = 'CANDIDATE'")).groupBy("origin").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("st7_latest_rollback", f"""WITH {T}, R AS (SELECT stream_id, observation_id AS seq, CASE WHEN event = 'REVERT_APPLIED' AND k % 10 = 0 THEN observation_id - 500 END AS target_seq FROM T),
  C AS (SELECT *, min(target_seq) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cut FROM R) SELECT seq FROM C WHERE target_seq IS NULL AND (cut IS NULL OR seq <= cut)""")
def st7(spark, sf):
    r = trace(spark, sf).select("stream_id", F.col("observation_id").alias("seq"), F.when((F.col("event") == "REVERT_APPLIED") & (F.col("k") % 10 == 0), F.col("observation_id") - 500).alias("target_seq"))
    return X.latest_rollback(r).select("seq")


def branch_tables(spark, sf):
    """Conversations as main lines; branches are runs of three turns, some as in the main line, some changed."""
    g = game(spark, sf).withColumn("next_state", F.lead("state").over(Window.partitionBy("stream_id").orderBy("seq")))
    b = g.join(g.select("stream_id", F.col("seq").alias("parent_seq")).filter("parent_seq % 2 = 0"), "stream_id").filter("seq >= parent_seq AND seq < parent_seq + 3").select(
        "stream_id", F.col("parent_seq").alias("branch_id"), "parent_seq", (F.col("seq") - F.col("parent_seq")).alias("step"), "state", "next_state",
        F.when((F.col("parent_seq") % 4 == 2) & (F.col("seq") > F.col("parent_seq")), F.concat(F.lit("x"), "move")).otherwise(F.col("move")).alias("move"),
        F.timestamp_micros(F.unix_micros("ts") + 10_000_000).alias("ts"), (F.length("state") * 7.0 + F.col("seq")).alias("score"))
    return g, b


BR = G + """, B AS (SELECT G.stream_id, P.seq AS branch_id, P.seq AS parent_seq, G.seq - P.seq AS step, G.state, CASE WHEN P.seq % 4 = 2 AND G.seq > P.seq THEN 'x' || G.move ELSE G.move END AS move, G.t + 10 AS t, length(G.state) * 7.0 + G.seq AS score
  FROM G JOIN G P ON P.stream_id = G.stream_id AND P.seq % 2 = 0 AND G.seq >= P.seq AND G.seq < P.seq + 3)"""


@query("j9_exact_replay_filter", f"""WITH {BR}, S AS (SELECT stream_id, branch_id, bool_and(B.move = (SELECT min(move) FROM G WHERE G.stream_id = B.stream_id AND G.seq = B.parent_seq + B.step)) AS replay FROM B GROUP BY ALL) SELECT stream_id, branch_id FROM S WHERE NOT replay""")
def j9(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.exact_replay_filter(b, g).select("stream_id", "branch_id").distinct()


@query("u7_trim_shared_prefix", f"""WITH {BR}, C AS (SELECT stream_id, branch_id, min(step) FILTER (branch_id % 4 = 2 AND step > 0) AS cut FROM B GROUP BY ALL) SELECT B.stream_id, B.branch_id, B.parent_seq + cut AS parent_seq, step - cut AS step FROM B JOIN C ON C.stream_id = B.stream_id AND C.branch_id = B.branch_id WHERE step >= cut""")
def u7(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.trim_shared_prefix(b, g).select("stream_id", "branch_id", "parent_seq", "step")


@query("j19_reanchor_branches", f"""WITH {BR}, H AS (SELECT stream_id, branch_id, arg_min(state, step) AS root, min(parent_seq) AS p FROM B GROUP BY ALL), K AS (SELECT H.*, seq, row_number() OVER (PARTITION BY H.stream_id, branch_id ORDER BY abs(seq - p), seq) AS r FROM H JOIN G ON G.stream_id = H.stream_id
  AND split_part(G.state, ' ', 1) || split_part(G.state, ' ', 2) = split_part(root, ' ', 1) || split_part(root, ' ', 2)) SELECT stream_id, branch_id, seq AS parent_seq FROM K WHERE r = 1""")
def j19(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.reanchor_branches(b, g).select("stream_id", "branch_id", "parent_seq").distinct()


@query("a32_weak_branch_filter", f"WITH {BR} SELECT stream_id, branch_id, count(*) AS steps FROM B GROUP BY ALL HAVING NOT (count(*) > 1 AND max(score) < 80)")
def a32(spark, sf):
    _, b = branch_tables(spark, sf)
    return B.weak_branch_filter(b, 80).groupBy("stream_id", "branch_id").agg(F.count("*").alias("steps"))


@query("a31_lcs_replay_test", f"""WITH {BR}, H AS (SELECT stream_id, branch_id, min(parent_seq) AS p, count(*) AS steps FROM B GROUP BY ALL),
  M AS (SELECT B.stream_id, B.branch_id, step, seq FROM B JOIN H ON H.stream_id = B.stream_id AND H.branch_id = B.branch_id JOIN G ON G.stream_id = B.stream_id AND G.move = B.move AND seq >= p AND seq < p + steps + 8),
  K AS (SELECT stream_id, branch_id, 1 AS n FROM M UNION ALL SELECT a.stream_id, a.branch_id, 2 FROM M a JOIN M b ON a.stream_id = b.stream_id AND a.branch_id = b.branch_id AND a.step < b.step AND a.seq < b.seq
  UNION ALL SELECT a.stream_id, a.branch_id, 3 FROM M a JOIN M b ON a.stream_id = b.stream_id AND a.branch_id = b.branch_id AND a.step < b.step AND a.seq < b.seq JOIN M c ON b.stream_id = c.stream_id AND b.branch_id = c.branch_id AND b.step < c.step AND b.seq < c.seq),
  L AS (SELECT stream_id, branch_id, max(n) AS n FROM K GROUP BY ALL) SELECT H.stream_id, H.branch_id, steps, CAST(coalesce(n, 0) AS BIGINT) AS matches, steps >= 2 AND coalesce(n, 0) >= 0.8 * steps AS replay FROM H LEFT JOIN L ON L.stream_id = H.stream_id AND L.branch_id = H.branch_id""")
def a31(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.lcs_replay_test(b, g, least=2)


@query("j15_join_continuations", f"""WITH RECURSIVE {BR}, N AS (SELECT stream_id, seq, split_part(lead(state) OVER (PARTITION BY stream_id ORDER BY seq), ' ', 1) || ' ' || split_part(lead(state) OVER (PARTITION BY stream_id ORDER BY seq), ' ', 2) AS nxt FROM G),
  K AS (SELECT B.*, t + branch_id AS ts, split_part(state, ' ', 1) || ' ' || split_part(state, ' ', 2) AS key, nxt FROM B JOIN N ON N.stream_id = B.stream_id AND N.seq = B.parent_seq + step WHERE step < 2),
  H AS (SELECT stream_id, branch_id, min(parent_seq) AS p, arg_min(key, step) AS root, min(ts) AS s, max(ts) AS e, count(*) AS n FROM K GROUP BY ALL), Z AS (SELECT H.*, nxt FROM H JOIN K ON K.stream_id = H.stream_id AND K.branch_id = H.branch_id AND K.step = n - 1),
  F AS (SELECT r.stream_id, r.branch_id, z.branch_id AS into_, z.n AS shift, r.s, row_number() OVER (PARTITION BY r.stream_id, r.branch_id ORDER BY z.e, z.branch_id) AS a FROM H r JOIN Z z ON z.stream_id = r.stream_id AND z.nxt = r.root AND z.branch_id <> r.branch_id AND r.s > z.e + 0.05),
  O AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, into_ ORDER BY s, branch_id) AS b FROM F WHERE a = 1) WHERE b = 1),
  U(stream_id, branch_id, into_, shift) AS (SELECT stream_id, branch_id, into_, shift FROM O UNION ALL SELECT U.stream_id, U.branch_id, O.into_, U.shift + O.shift FROM U JOIN O ON O.stream_id = U.stream_id AND O.branch_id = U.into_),
  T AS (SELECT U.*, H.p FROM U JOIN H ON H.stream_id = U.stream_id AND H.branch_id = U.into_ WHERE NOT EXISTS (SELECT 1 FROM O WHERE O.stream_id = U.stream_id AND O.branch_id = U.into_))
  SELECT K.stream_id, coalesce(T.into_, K.branch_id) AS branch_id, coalesce(T.p, K.parent_seq) AS parent_seq, K.step + coalesce(T.shift, 0) AS step, K.move FROM K LEFT JOIN T ON T.stream_id = K.stream_id AND T.branch_id = K.branch_id""")
def j15(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.join_continuations(b.filter("step < 2").withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("branch_id") * 1_000_000))).select("stream_id", "branch_id", "parent_seq", "step", "move")


@query("j15_join_interiors")
def j15i(spark, sf):
    _, b = branch_tables(spark, sf)
    return B.join_interiors(b).select("stream_id", "branch_id", "parent_seq", "step", "move")


@query("u5_prefix_supersede", f"""WITH {BR}, H AS (SELECT stream_id, branch_id, min(parent_seq) AS p, count(*) AS n FROM B GROUP BY ALL), C AS (SELECT s.stream_id, s.branch_id FROM H s JOIN H g ON g.stream_id = s.stream_id AND g.branch_id <> s.branch_id
  AND (g.p <> s.p OR s.n < g.n OR g.branch_id < s.branch_id) AND NOT EXISTS (SELECT 1 FROM B x WHERE x.stream_id = s.stream_id AND x.branch_id = s.branch_id AND NOT EXISTS (SELECT 1 FROM B y WHERE y.stream_id = g.stream_id AND y.branch_id = g.branch_id AND y.step = x.step + s.p - g.p AND y.move = x.move)))
  SELECT stream_id, branch_id, parent_seq, step, move FROM B WHERE NOT EXISTS (SELECT 1 FROM C WHERE C.stream_id = B.stream_id AND C.branch_id = B.branch_id)""")
def u5(spark, sf):
    _, b = branch_tables(spark, sf)
    return B.prefix_supersede(b).select("stream_id", "branch_id", "parent_seq", "step", "move")


@query("j23_flatten_orphan_forks", f"""WITH {BR}, K AS (SELECT *, split_part(state, ' ', 1) || split_part(state, ' ', 2) AS key FROM B), H AS (SELECT stream_id, branch_id, min(parent_seq) AS p, arg_min(key, step) AS root FROM K GROUP BY ALL),
  M AS (SELECT stream_id, max(seq) AS last FROM G WHERE seq < 4 GROUP BY stream_id), T AS (SELECT H.*, p > coalesce(last, -1) AS beyond FROM H LEFT JOIN M ON M.stream_id = H.stream_id),
  O AS (SELECT T.stream_id, T.branch_id, min({{'u': K.branch_id, 's': K.step}}) AS home FROM T JOIN K ON K.stream_id = T.stream_id AND K.key = T.root AND K.branch_id <> T.branch_id AND K.step > 0 WHERE beyond GROUP BY ALL)
  SELECT B.stream_id, B.branch_id, step, home.u AS under, home.s AS under_step FROM B JOIN T ON T.stream_id = B.stream_id AND T.branch_id = B.branch_id LEFT JOIN O ON O.stream_id = B.stream_id AND O.branch_id = B.branch_id WHERE NOT beyond OR home IS NOT NULL""")
def j23(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.flatten_orphan_forks(b, g.filter("seq < 4")).select("stream_id", "branch_id", "step", "under", "under_step")


@query("a26_move_budget", f"""WITH {G}, K AS (SELECT stream_id, move, count(*) // 2 AS k FROM G GROUP BY ALL), R AS (SELECT G.*, k, row_number() OVER (PARTITION BY G.stream_id, G.move ORDER BY t, seq) AS r FROM G JOIN K ON K.stream_id = G.stream_id AND K.move = G.move)
  SELECT stream_id, seq, CASE WHEN r <= k THEN 'transition' ELSE 'rollback' END AS kind FROM R""")
def a26(spark, sf):
    g = game(spark, sf)
    k = g.groupBy("stream_id", "move").agg(F.floor(F.count("*") / 2).alias("k"))
    return B.move_budget(g, k).select("stream_id", "seq", "kind")


@query("v2_trace_invariants", f"""WITH {T}, A AS (SELECT *, lag(move || state || branch_id) OVER ({ORD}) AS p, row_number() OVER (PARTITION BY stream_id, candidate_id ORDER BY ts, observation_id) AS r FROM T WHERE event = 'ACCEPT'),
  S AS (SELECT *, min(CASE WHEN event <> 'REVERT_APPLIED' THEN epoch_us(ts) END) OVER (PARTITION BY stream_id, state) AS f, first(state) OVER (PARTITION BY stream_id, candidate_id, generation ORDER BY ts, observation_id ROWS UNBOUNDED PRECEDING) AS baseline FROM T)
  SELECT finding, count(*) AS n FROM (SELECT CASE WHEN move || state || branch_id = p THEN 'repeated_accept' WHEN r > 1 THEN 'candidate_accepted_twice' END AS finding FROM A UNION ALL
  SELECT 'unknown_rollback_target' FROM S WHERE event = 'REVERT_APPLIED' AND (f IS NULL OR f >= epoch_us(ts)) UNION ALL SELECT 'rejected_mutation' FROM S WHERE event = 'VALIDATION_REJECTED' AND state IS DISTINCT FROM baseline) WHERE finding IS NOT NULL GROUP BY finding""")
def v2(spark, sf):
    t = trace(spark, sf).withColumn("outcome", F.when(F.col("event") == "VALIDATION_REJECTED", "rejected"))
    return C.trace_invariants(t).groupBy("finding").agg(F.count("*").alias("n"))


@query("v3_observation_contract", f"""WITH {RUNS}, U AS (SELECT * FROM B UNION ALL SELECT * FROM B WHERE k = 7), D AS (SELECT stream_id, observation_id FROM U GROUP BY ALL HAVING count(*) > 1), M AS (SELECT seconds, lag(seconds) OVER ({ORD}) AS p FROM T)
  SELECT 'duplicate_id' AS finding, count(*) AS n FROM D UNION ALL SELECT 'not_monotonic', count(*) FROM M WHERE seconds < p""")
def v3(spark, sf):
    a, b = two_runs(spark, sf)
    twice = C.observation_contract(b.unionByName(b.filter("k = 7")).withColumn("sequence", F.col("ts")))
    falls = C.observation_contract(a.withColumn("sequence", F.struct("ts", "observation_id")).withColumn("ts", F.col("seconds")))
    return twice.filter("finding = 'duplicate_id'").unionByName(falls.filter("finding = 'not_monotonic'")).groupBy("finding").agg(F.count("*").alias("n"))


@query("v4_summary_contract", f"""WITH {REPORTS} SELECT 'unknown_status' AS finding, count(*) AS n FROM Q WHERE move = 'm4' UNION ALL SELECT 'interval', count(*) FROM Q WHERE report_id % 9 = 0 UNION ALL SELECT 'required_field', count(*) FROM Q WHERE move = 'm0'""")
def v4(spark, sf):
    r = reports(spark, sf)
    s = r.select("stream_id", F.col("report_id").alias("summary_id"), F.when(F.col("report_id") % 9 == 0, F.col("stop")).otherwise(F.col("start")).alias("start"),
                 F.when(F.col("report_id") % 9 == 0, F.col("start")).otherwise(F.col("stop")).alias("stop"), F.col("move").alias("status"), F.when(F.col("move") != "m0", F.col("move")).alias("needed"))
    return C.summary_contract(s, ["needed"], ("m0", "m1", "m2", "m3")).groupBy("finding").agg(F.count("*").alias("n"))


@query("v5_compare_runs", f"""WITH {RUNS} SELECT T.observation_id, 'state' AS path, T.state AS expected, B.state AS actual FROM T JOIN B ON T.observation_id = B.observation_id WHERE T.state <> B.state""")
def v5(spark, sf):
    a, b = two_runs(spark, sf)

    def fields(d, tag):
        return d.select("observation_id", F.create_map(F.lit("state"), F.col("state"), F.lit("event"), F.col("event"), F.lit("evidence.diagnostic_board_path"), F.lit(tag)).alias("fields"))

    both = b.select("observation_id").intersect(a.select("observation_id"))
    return C.compare_runs(fields(a, "run1").join(both, "observation_id", "left_semi"), fields(b, "run2").join(both, "observation_id", "left_semi"), ["observation_id"])


@query("v5_compare_json_runs", f"""WITH {RUNS} SELECT observation_id, CASE WHEN observation_id % 59 = 0 THEN '$.cells[1]' WHEN observation_id % 61 = 0 THEN '$.cells[2]' WHEN observation_id % 67 = 0 THEN '$.evidence.note' WHEN observation_id % 71 = 0 THEN '$.evidence.votes[0].n' ELSE '$.state' END AS path,
  CASE WHEN observation_id % 59 = 0 THEN 'integer' WHEN observation_id % 61 = 0 THEN NULL WHEN observation_id % 67 = 0 THEN 'null' WHEN observation_id % 71 = 0 THEN 'integer' ELSE 'string' END AS expected_kind,
  CASE WHEN observation_id % 59 = 0 THEN 'integer' WHEN observation_id % 61 = 0 THEN 'integer' WHEN observation_id % 67 = 0 THEN NULL WHEN observation_id % 71 = 0 THEN 'number' ELSE 'string' END AS actual_kind
  FROM (SELECT T.observation_id, T.state <> B.state AS changed FROM T JOIN B ON T.observation_id = B.observation_id) WHERE changed OR observation_id % 59 = 0 OR observation_id % 61 = 0 OR observation_id % 67 = 0 OR observation_id % 71 = 0""")
def v5_json(spark, sf):
    """Nested records: array items changed or added, a null that goes, a number of another kind, a state; paths of the run differ always."""
    a, b = two_runs(spark, sf)
    i = F.col("observation_id")

    def records(d, tag):
        other = F.lit(tag == "run2")
        cells = F.when(other & (i % 59 == 0), F.lit("[1,9]")).when(other & (i % 61 == 0), F.lit("[1,2,3]")).otherwise(F.lit("[1,2]"))
        note = F.when(other & (i % 67 == 0), F.lit("")).otherwise(F.lit('"note":null,'))
        votes = F.when(other & (i % 71 == 0), F.lit("0.5")).otherwise(F.lit("4"))
        return d.select("observation_id", F.concat(
            F.lit("{"), F.expr("substr(to_json(struct(state)), 2, length(to_json(struct(state))) - 2)"), F.lit(',"evidence":{"diagnostic_board_path":"'), F.lit(tag), F.lit('",'), note, F.lit('"votes":[{"n":'), votes,
            F.lit('}]},"cells":'), cells, F.lit("}")).alias("record"))

    both = b.select("observation_id").intersect(a.select("observation_id"))
    found = C.compare_json_runs(*(records(d, t).join(both, "observation_id", "left_semi") for d, t in ((a, "run1"), (b, "run2"))), ["observation_id"])
    return found.select("observation_id", "path", "expected_kind", "actual_kind")


@query("v6_compare_mapping_runs", f"""WITH {RUNS}, A1 AS (SELECT stream_id, row_number() OVER ({ORD}) - 1 AS position, event, state, k FROM T), B1 AS (SELECT stream_id, row_number() OVER ({ORD}) - 1 AS position, event, state, k FROM B),
  M AS (SELECT CASE WHEN A1.event IS NULL OR B1.event IS NULL OR A1.event <> B1.event THEN 'emission' WHEN A1.k <> B1.k THEN 'evidence' WHEN A1.state <> B1.state THEN 'state' END AS layer FROM A1 FULL JOIN B1 ON A1.stream_id = B1.stream_id AND A1.position = B1.position)
  SELECT layer, count(*) AS n FROM M WHERE layer IS NOT NULL GROUP BY layer""")
def v6(spark, sf):
    a, b = (d.withColumn("emission", F.col("event")).withColumn("evidence_key", F.col("k")).withColumn("scoring", F.col("k")) for d in two_runs(spark, sf))
    return C.compare_mapping_runs(a, b).groupBy("layer").agg(F.count("*").alias("n"))


_FAMILY = "CASE WHEN event = 'ACCEPT' THEN 'accepted' WHEN event LIKE 'CLOCK%' THEN 'readings' WHEN event LIKE 'REVERT%' OR event LIKE 'HANDOFF%' THEN 'recovery' WHEN event LIKE 'VARIATION%' THEN 'branches' END"


@query("v7_compare_semantics", f"""WITH {RUNS}, A1 AS (SELECT stream_id, {_FAMILY} AS family, event, event || '|' || state || '|' || move AS s, row_number() OVER (PARTITION BY stream_id, {_FAMILY} ORDER BY ts, observation_id) - 1 AS position FROM T WHERE {_FAMILY} IS NOT NULL),
  B1 AS (SELECT stream_id, {_FAMILY} AS family, event, event || '|' || state || '|' || move AS s, row_number() OVER (PARTITION BY stream_id, {_FAMILY} ORDER BY ts, observation_id) - 1 AS position FROM B WHERE {_FAMILY} IS NOT NULL),
  M AS (SELECT coalesce(A1.stream_id, B1.stream_id) AS stream_id, coalesce(A1.family, B1.family) AS family, coalesce(A1.position, B1.position) AS position, coalesce(A1.event, B1.event) AS event
  FROM A1 FULL JOIN B1 ON A1.stream_id = B1.stream_id AND A1.family = B1.family AND A1.position = B1.position WHERE A1.s IS DISTINCT FROM B1.s)
  SELECT stream_id, family, CAST(min(position) AS INT) AS position, CASE WHEN arg_min(event, position) LIKE 'CLOCK%' THEN 'detector_or_validation' WHEN arg_min(event, position) LIKE 'VARIATION%' THEN 'reducer_or_trace_contract' ELSE 'reducer' END AS layer FROM M GROUP BY stream_id, family""")
def v7(spark, sf):
    a, b = (d.withColumn("metadata", F.concat(F.lit("kind=a;ts="), F.col("observation_id").cast("string"))) for d in two_runs(spark, sf))
    return C.compare_semantics(a, b).select("stream_id", "family", "position", "layer")


@query("v8_evidence_window", f"""WITH {REPORTS}, N AS (SELECT report_id, report_id % 5 AS a, report_id % 5 + report_id % 3 AS b, 0.0 AS rs, 6.0 AS re FROM Q), W AS (SELECT *, greatest(a - 1.0, rs) AS x, least(b + 1.0, re) AS y FROM N), Z AS (SELECT *, greatest(y, x + 0.5) AS z FROM W)
  SELECT report_id, CAST(CASE WHEN z - x < re - rs THEN x END AS DOUBLE) AS window_start, CAST(CASE WHEN z - x < re - rs THEN z END AS DOUBLE) AS window_stop FROM Z""")
def v8(spark, sf):
    n = reports(spark, sf).select("report_id", (F.col("report_id") % 5).cast("double").alias("start"), (F.col("report_id") % 5 + F.col("report_id") % 3).cast("double").alias("stop"), F.lit(0.0).alias("run_start"), F.lit(6.0).alias("run_stop"))
    return C.evidence_window(n).select("report_id", "window_start", "window_stop")


@query("s14_divergence_report", f"""WITH {RUNS}, A1 AS (SELECT stream_id, row_number() OVER ({ORD}) - 1 AS position, move FROM T), B1 AS (SELECT stream_id, row_number() OVER ({ORD}) - 1 AS position, move FROM B),
  M AS (SELECT coalesce(A1.stream_id, B1.stream_id) AS stream_id, coalesce(A1.position, B1.position) AS position, A1.move AS e, B1.move AS a FROM A1 FULL JOIN B1 ON A1.stream_id = B1.stream_id AND A1.position = B1.position WHERE A1.move IS DISTINCT FROM B1.move),
  F AS (SELECT stream_id, min(position) AS position, arg_min(coalesce(e, '-'), position) AS e, arg_min(coalesce(a, '-'), position) AS a FROM M GROUP BY stream_id) SELECT stream_id, CAST(position AS INT) AS position, CASE WHEN a = '-' THEN 'missing' WHEN e = '-' THEN 'unexpected' ELSE 'different' END AS kind FROM F""")
def s14(spark, sf):
    return C.divergence_report(*two_runs(spark, sf)).select("stream_id", "position", "kind")
