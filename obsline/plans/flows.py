"""Queries for stateful operators ST1-ST22 in batch form, frames P2-P7, and text sources S7-S13."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsline.operators import branches as B
from obsline.operators import measure as P
from obsline.operators import verify as C
from obsline.operators.joins import similar_state_join
from obsline.plans.base import ORD, E, G, T, V, events, game, query, rounded, table, trace, vectors
from obsline.plans.matching import BR, branch_tables
from obsline.sources import tables as S
from obsline.streaming import run as R


def motion(spark, sf):
    """Each user's events as rows with motion: seconds are hours of the real time."""
    e = events(spark, sf)
    return e.select("stream_id", "observation_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("ts"), (F.col("k") % 3 > 0).alias("has_motion"),
                    (F.col("k") % 10 == 0).alias("motion_spike"), F.col("value").alias("score"), F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("move"))


@query("st1_chunk_tumbling", f"WITH {E} SELECT stream_id, time_bucket(INTERVAL 1 DAY, ts) AS chunk_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS chunk_end, count(*) AS n FROM E GROUP BY ALL")
def st1(spark, sf):
    return R.chunk_tumbling(events(spark, sf), "1 day")


@query("st3_sessions", f"""WITH {E}, N AS (SELECT *, CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORD}) >= 21600000000, true) AS INT) AS new FROM E), I AS (SELECT *, sum(new) OVER ({ORD}) AS s FROM N)
  SELECT stream_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM I GROUP BY stream_id, s""")
def st3(spark, sf):
    return R.sessions(events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


#: The rows of motion() as SQL, numbered within each stream; state machines step through them by recursion.
MOTION = E + """, MO AS (SELECT stream_id, observation_id, epoch_us(ts) / 3.6e9 AS ts, k % 3 > 0 AS has_motion, k % 10 = 0 AS motion_spike, value AS score, 'm' || CAST(k % 3 AS VARCHAR) AS move FROM E),
N AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, observation_id) AS n FROM MO)"""


# State after each row: last emission, whether a burst is pending, quiet time; branch says which rule fitted.
@query("st3_coalesce_bursts", f"""WITH RECURSIVE {MOTION}, S(stream_id, n, ts, observation_id, last_emit, pending, quiet, first_ts, first_id, first_reason, cap) AS (
  SELECT stream_id, n, ts, observation_id, ts, false, CAST(0 AS DOUBLE), ts, observation_id, 'initial_frame', false FROM N WHERE n = 1
  UNION ALL SELECT stream_id, n, ts, id, coalesce(CASE WHEN cap THEN ts END, emitted, last_emit), CASE WHEN branch = 'motion' THEN true WHEN tail THEN false ELSE pending END, CASE WHEN has_motion OR NOT (pending AND NOT tail) THEN 0.0 WHEN branch = 'quiet' THEN q ELSE quiet END,
    CASE WHEN branch = 'spike' AND emitted IS NOT NULL THEN p_ts WHEN emitted IS NOT NULL THEN ts END, CASE WHEN branch = 'spike' AND emitted IS NOT NULL THEN p_id WHEN emitted IS NOT NULL THEN id END, CASE WHEN emitted IS NOT NULL THEN CASE branch WHEN 'spike' THEN 'motion_spike_prev_frame' WHEN 'motion' THEN 'motion_leading_edge' ELSE 'settled_tail' END END, cap
  FROM (SELECT *, branch = 'quiet' AND q >= 0.2 - 1e-9 AS tail, CASE WHEN branch = 'spike' AND p_ts > last_emit + 0.02 THEN p_ts WHEN branch = 'motion' AND NOT pending AND ts > last_emit + 0.02 THEN ts WHEN branch = 'quiet' AND q >= 0.2 - 1e-9 THEN ts END AS emitted,
    branch = 'motion' AND ts - CASE WHEN NOT pending AND ts > last_emit + 0.02 THEN ts ELSE last_emit END > 0.3 AS cap
    FROM (SELECT N.stream_id, N.n, N.ts, N.observation_id AS id, N.has_motion, S.ts AS p_ts, S.observation_id AS p_id, S.last_emit, S.pending, S.quiet, S.quiet + N.ts - S.ts AS q, CASE WHEN N.motion_spike AND S.pending THEN 'spike' WHEN N.has_motion THEN 'motion' WHEN S.pending THEN 'quiet' ELSE 'none' END AS branch
      FROM S JOIN N ON N.stream_id = S.stream_id AND N.n = S.n + 1)))
  SELECT stream_id, round(first_ts, 6) AS ts, first_id AS observation_id, first_reason AS reason FROM S WHERE first_reason IS NOT NULL UNION ALL SELECT stream_id, round(ts, 6), observation_id, 'motion_burst_cap' FROM S WHERE cap""")
def st3b(spark, sf):
    return rounded(R.coalesce_bursts(motion(spark, sf)), digits=6)


@query("st4_adaptive_sampler", f"""WITH RECURSIVE {MOTION}, S(stream_id, n, ts, observation_id, taken, due, quiet, last, step) AS (
  SELECT stream_id, n, ts, observation_id, true, ts + 0.1, CAST(0 AS DOUBLE), ts, CAST(0.1 AS DOUBLE) FROM N WHERE n = 1
  UNION ALL SELECT stream_id, n, ts, id, taken, CASE WHEN taken THEN ts + CASE WHEN q >= 2 THEN 1.0 ELSE 0.1 END ELSE due END, CASE WHEN taken THEN q ELSE quiet END, CASE WHEN taken THEN ts ELSE last END, CASE WHEN q >= 2 THEN 1.0 ELSE 0.1 END
  FROM (SELECT N.stream_id, N.n, N.ts, N.observation_id AS id, N.ts >= S.due - 1e-9 AS taken, S.due, S.quiet, S.last, CASE WHEN N.has_motion THEN 0.0 ELSE S.quiet + N.ts - S.last END AS q FROM S JOIN N ON N.stream_id = S.stream_id AND N.n = S.n + 1))
  SELECT stream_id, round(ts, 6) AS ts, observation_id, CAST(step AS DOUBLE) AS sampling_step FROM S WHERE taken""")
def st4(spark, sf):
    return rounded(R.adaptive_sampler(motion(spark, sf)), digits=6)


def settle_sql(hold: float, retarget: bool) -> str:
    """A candidate held: its time, id, move and score after each row, and what each row closes."""
    return f"""WITH RECURSIVE {MOTION}, S(stream_id, n, h_ts, h_id, h_move, h_score, x, y) AS (
  SELECT stream_id, n, ts, observation_id, move, score, CAST(NULL AS STRUCT(ts DOUBLE, id BIGINT, move VARCHAR, score DOUBLE)), CAST(NULL AS STRUCT(ts DOUBLE, id BIGINT, move VARCHAR, score DOUBLE)) FROM N WHERE n = 1
  UNION ALL SELECT stream_id, n, CASE WHEN same THEN NULL WHEN free THEN ts ELSE h_ts END, CASE WHEN same THEN NULL WHEN free OR better THEN id ELSE h_id END, CASE WHEN same THEN NULL WHEN free OR better THEN move ELSE h_move END,
    CASE WHEN same THEN NULL WHEN free OR better THEN score ELSE h_score END, CASE WHEN late THEN {{'ts': h_ts, 'id': h_id, 'move': h_move, 'score': h_score}} END, CASE WHEN same THEN {{'ts': h_ts, 'id': h_id, 'move': h_move, 'score': greatest(h_score, score)}} END
  FROM (SELECT *, NOT free AND move = h_move AS same, {str(retarget).lower()} AND NOT free AND move <> h_move AND score >= h_score + 8 AS better FROM (SELECT N.stream_id, N.n, N.ts, N.observation_id AS id, N.move, N.score, S.h_ts, S.h_id, S.h_move, S.h_score,
    S.h_ts IS NOT NULL AND N.ts > S.h_ts + {hold} AS late, S.h_ts IS NULL OR N.ts > S.h_ts + {hold} AS free FROM S JOIN N ON N.stream_id = S.stream_id AND N.n = S.n + 1)))
  SELECT stream_id, round(x.ts, 6) AS ts, x.id AS observation_id, x.move AS move, round(x.score, 6) AS score, 'window_expired' AS outcome FROM S WHERE x IS NOT NULL UNION ALL SELECT stream_id, round(y.ts, 6), y.id, y.move, round(y.score, 6), 'candidate_found' FROM S WHERE y IS NOT NULL
  UNION ALL SELECT stream_id, round(h_ts, 6), h_id, h_move, round(h_score, 6), 'no_future_candidate' FROM S WHERE h_ts IS NOT NULL AND n = (SELECT max(n) FROM N WHERE N.stream_id = S.stream_id)"""


@query("st5_settle_hold", settle_sql(12.0, True))
def st5(spark, sf):
    return rounded(R.settle_hold(motion(spark, sf), 12.0), digits=6)


@query("st11_pending_endpoint", settle_sql(0.75, False))
def st11(spark, sf):
    return rounded(R.pending_endpoint(motion(spark, sf)), digits=6)


@query("st12_probe_throttle", f"""WITH RECURSIVE {MOTION}, S(stream_id, n, ts, observation_id, taken, due) AS (SELECT stream_id, n, ts, observation_id, true, ts + 30 FROM N WHERE n = 1
  UNION ALL SELECT N.stream_id, N.n, N.ts, N.observation_id, N.ts >= S.due - 1e-9, CASE WHEN N.ts >= S.due - 1e-9 THEN N.ts + 30 ELSE S.due END FROM S JOIN N ON N.stream_id = S.stream_id AND N.n = S.n + 1)
  SELECT stream_id, round(ts, 6) AS ts, observation_id FROM S WHERE taken""")
def st12(spark, sf):
    return rounded(R.probe_throttle(motion(spark, sf), 30), digits=6)


def reducer_rows(spark, sf):
    """Vectors as observations of ten streams, each with a candidate whose scores come from its cells."""
    v = vectors(spark, sf)
    a, b = F.col("cells")[0], F.col("cells")[1]
    square = lambda x: F.concat(F.get(F.array(*map(F.lit, "abcdefgh")), (F.floor(x).cast("int") % 8)), ((F.floor(x / 8).cast("int") % 8) + 1).cast("string"))
    return v.select("stream_id", "observation_id", (F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) * 5.0).alias("ts"), "cells", F.lit(True).alias("stable"),
                    F.concat(square(a), square(b)).alias("move"), ((a + b) / 3).alias("score"), (a / 3).alias("origin"), (b / 3).alias("target"), (F.col("seq") % 50 != 0).alias("allowed"),
                    F.lit(2).alias("changed"), (F.col("seq") % 2 == 0).alias("supported"), (F.col("seq") % 31 == 0).alias("hover"),
                    F.when(F.col("seq") % 20 < 10, "w").otherwise("b").alias("side"), (3600 - F.col("seq") % 600).alias("seconds"), F.lit(2).alias("observed"), F.lit(2).alias("agreeing"))


@query("st6_verified_timeline")
def st6(spark, sf):
    return R.verified_timeline(reducer_rows(spark, sf)).select("stream_id", "observation_id", "event", "reason", "seq", "move", "generation")


@query("st6_timeline_ahead")
def st6_ahead(spark, sf):
    return R.timeline_ahead(reducer_rows(spark, sf)).select("stream_id", "observation_id", "event", "reason", "seq", "move", "generation", "reading")


@query("st8_rollback_confirmation", f"""WITH {E}, B AS (SELECT *, min(CASE WHEN k < 4 THEN epoch_us(ts) END) OVER (PARTITION BY stream_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS b FROM E)
  SELECT observation_id, b IS NOT NULL AND b > epoch_us(ts) AS returns_soon, coalesce(b > epoch_us(ts) AND b - epoch_us(ts) <= 14400000000, false) AS bounces FROM B""")
def st8(spark, sf):
    found = R.rollback_confirmation(events(spark, sf).withColumn("active_diff", F.col("k").cast("double")), 86400, 4.0, 14400)
    return found.select("observation_id", "returns_soon", F.coalesce("bounces", F.lit(False)).alias("bounces"))


@query("st14_dedup_observations", f"WITH {T} SELECT stream_id, observation_id FROM T")
def st14(spark, sf):
    t = trace(spark, sf).select("stream_id", "observation_id")
    return R.dedup_observations(t.unionByName(t))


@query("st15_late_rows", f"WITH {E}, H AS (SELECT *, max(ts) OVER (PARTITION BY stream_id ORDER BY observation_id + (k % 2) * 400 * 2, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM E) SELECT observation_id FROM H WHERE ts < high")
def st15(spark, sf):
    return R.late_rows(events(spark, sf).withColumn("arrival", F.struct(F.col("observation_id") + (F.col("k") % 2) * 800, "observation_id"))).select("observation_id")


@query("st18_reading_settle", f"""WITH {E}, S AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) OVER (PARTITION BY stream_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS stop FROM E),
  P AS (SELECT a.observation_id, b.k % 4 AS reading FROM S a JOIN E b ON a.stream_id = b.stream_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + 86400000000 AND (a.stop IS NULL OR epoch_us(b.ts) < a.stop)),
  C AS (SELECT observation_id, reading, count(*) AS n FROM P GROUP BY ALL), M AS (SELECT observation_id, CAST(sum(n) AS INT) AS samples, max((n, reading)) AS top FROM C GROUP BY observation_id)
  SELECT E.observation_id, coalesce(samples, 0) AS samples, CAST(top[2] AS INT) AS reading FROM E LEFT JOIN M ON M.observation_id = E.observation_id""")
def st18(spark, sf):
    e = events(spark, sf).withColumn("rollback", F.col("event_type") == "signup").withColumn("reading", F.col("k") % 4)
    return R.reading_settle(e, 86400).select("observation_id", "samples", F.col("settled.reading").alias("reading"))


@query("st19_reading_backfill", f"""WITH {E}, B AS (SELECT *, k % 3 > 0 AS seen, first_value(CASE WHEN k % 3 > 0 THEN seconds END IGNORE NULLS) OVER (PARTITION BY stream_id, side ORDER BY ts, observation_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
  last_value(CASE WHEN k % 3 > 0 THEN seconds END IGNORE NULLS) OVER (PARTITION BY stream_id, side ORDER BY ts, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM E)
  SELECT observation_id, CASE WHEN seen THEN seconds WHEN abs(b - a) <= 180 AND a <= b + 65 THEN a ELSE b END AS repaired FROM B""")
def st19(spark, sf):
    return R.reading_backfill(events(spark, sf).withColumn("observed", F.col("k") % 3 > 0)).select("observation_id", "repaired")


@query("st21_rebase_continuation", f"""WITH {E}, S AS (SELECT *, epoch_us(ts) / 1000000 AS s, last_value(CASE WHEN event_type = 'signup' THEN epoch_us(ts) / 1000000 END IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS r FROM E),
  N AS (SELECT *, row_number() OVER (PARTITION BY stream_id, r ORDER BY s, observation_id) AS n FROM S WHERE s > r AND s - r <= 86400 AND value >= 20 AND k % 2 = 0) SELECT observation_id FROM N WHERE n <= 2""")
def st21(spark, sf):
    e = events(spark, sf).withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = Window.partitionBy("stream_id").orderBy("ts", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("replaced_at", F.last(F.when(F.col("event_type") == "signup", F.col("ts_s")), ignorenulls=True).over(w)).withColumn("score", F.col("value")).withColumn("allowed", F.col("k") % 2 == 0)
    return R.rebase_continuation(e, 2, 86400, 20).select("observation_id")


@query("st22_adjacent_alternative", """WITH C AS (SELECT user_id AS stream_id, event_id // 4 AS observation_id, event_id AS candidate, value * 10 AS score, event_id % 60 AS o, event_id // 3 % 60 AS t, event_id % 20 AS age FROM events),
  R AS (SELECT *, row_number() OVER (PARTITION BY stream_id, observation_id ORDER BY score DESC, candidate) AS r FROM C WHERE score >= 120 AND o >= 35 AND t >= 35 AND o + t >= 90 AND age <= 15) SELECT stream_id, observation_id, candidate FROM R WHERE r = 1""")
def st22(spark, sf):
    i = F.col("event_id")
    c = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.floor(i / 4).alias("observation_id"), i.alias("candidate"), (F.col("value") * 10).alias("score"), (i % 60).alias("origin"), (F.floor(i / 3) % 60).alias("target"), (i % 20).alias("age"))
    return R.adjacent_alternative(c).select("stream_id", "observation_id", "candidate")


def as_byte(x):
    """A component as 0 to 255, in its own precision as in SQL: a float that is widened first can fall on the other side of a whole number. NaN is the greatest."""
    single = lambda v: F.lit(v).cast("float")
    return F.floor(F.least(F.greatest((x + single(0.5)) * single(255), single(0)), single(255))).cast("int")


def frames(spark, sf, red: bool = False):
    """Embeddings as frames of 8 x 8 cells of 4 x 4 pixels: three equal planes, a cell's value all over it; with ``red`` every third
    cell has up to 100 more in its red plane."""
    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("stream_id"), F.col("vec_id").alias("observation_id"), F.transform("embedding", as_byte).alias("v"))
    # The top row of the picture shows cells 56 to 63.
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    pixel = lambda x, more: F.concat(two(x), two(x), two(F.least(x + F.when(more, 100).otherwise(0), F.lit(255))))
    row = lambda r: F.repeat(F.array_join(F.transform(F.slice("v", r * 8 + 1, 8), lambda x, i: F.repeat(pixel(x, F.lit(red) & ((i + r * 8) % 3 == 0)), F.lit(4))), ""), F.lit(4))
    text = F.concat(*(row(r) for r in range(7, -1, -1)))
    return v.select("stream_id", "observation_id", F.unhex(text).alias("pixels"), F.lit(32).alias("height"), F.lit(32).alias("width"))


@query("p2_grid_means", """SELECT vec_id AS observation_id, CAST(list_max(list_transform(embedding, lambda x: least(greatest(floor((x + 0.5) * 255), 0), 255))) AS DOUBLE) AS most, CAST(least(greatest(floor((embedding[1] + 0.5) * 255), 0), 255) AS DOUBLE) AS first FROM embeddings""")
def p2(spark, sf):
    return rounded(P.measure_frames(frames(spark, sf)).select("observation_id", F.array_max("cells").alias("most"), F.col("cells")[0].alias("first")), digits=6)


@query("p3_p5_cell_flags", """WITH C AS (SELECT vec_id % 10 AS stream_id, vec_id AS observation_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x + 0.5) * 255), 0), 255) AS INT)) AS v FROM embeddings),
  D AS (SELECT *, list_transform(v, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN least(x + 100, 255) - x ELSE 0 END) AS r FROM C), H AS (SELECT *, least(35, greatest(list_max(r) / 2, 1)) AS over FROM D)
  SELECT stream_id, observation_id, array_to_string(list_filter(list_transform(r, lambda x, i: CASE WHEN x > over THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS red_cells,
  array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN x + 0.299 * r[i] > 200 THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS hover_cells, CAST(0 AS DOUBLE) AS most_highlight FROM H""")
def p3(spark, sf):
    m = P.hover_flag(P.red_cells(P.measure_frames(frames(spark, sf, red=True))))
    return m.select("stream_id", "observation_id", F.array_join("red_cells", ",").alias("red_cells"), F.array_join("hover_cells", ",").alias("hover_cells"), F.array_max("highlight").alias("most_highlight"))


@query("p6_active_side", """WITH C AS (SELECT vec_id AS observation_id, len(list_filter(embedding[1:32], lambda x: floor((x + 0.5) * 255) > 120)) * 4 AS t, len(list_filter(embedding[33:64], lambda x: floor((x + 0.5) * 255) > 120)) * 4 AS b FROM embeddings)
  SELECT observation_id, CASE WHEN t < 50 AND b < 50 THEN 'none' WHEN t >= b THEN 'top' ELSE 'bottom' END AS active_side, (t - b) / 128 AS bright_delta FROM C""")
def p6(spark, sf):
    def region(lo):
        return F.unhex(F.array_join(F.transform(F.slice("embedding", lo, 32), lambda x: F.repeat(F.lpad(F.hex(as_byte(x)), 2, "0"), F.lit(4))), ""))

    r = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("stream_id"), F.col("vec_id").alias("observation_id"), region(1).alias("top"), region(33).alias("bottom"))
    return P.active_side(P.bright_regions(r, 120)).select("observation_id", "active_side", "bright_delta")


@query("s7_game_tokens", f"""WITH B AS (SELECT doc_id AS stream_id, regexp_extract_all(regexp_replace(text, '(?m)^\\[[^\\n]*\\]\\s*$', '', 'g'), '{S.TOKEN}') AS t FROM documents),
  U AS (SELECT stream_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM B), D AS (SELECT *, sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos) AS depth FROM U)
  SELECT stream_id, count(*) AS tokens, CAST(max(depth) AS BIGINT) AS deepest FROM D GROUP BY stream_id""")
def s7(spark, sf):
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("stream_id"), F.col("text").alias("value"))
    return S.game_tokens(t).groupBy("stream_id").agg(F.count("*").alias("tokens"), F.max("depth").alias("deepest"))


@query("s8_lookup_response", """SELECT event_id AS lookup_id, CASE WHEN event_id % 3 = 0 THEN 'A' || CAST(event_id % 9 AS VARCHAR) ELSE 'B0' END AS code, CASE WHEN event_id % 3 = 0 THEN 'Named' ELSE 'Early' END AS name, event_id % 10 + event_id % 4 AS total_games FROM events""")
def s8(spark, sf):
    i = F.col("event_id")
    early = '{"opening": {"eco": "B0", "name": "Early"}}\nnot json\n'
    last = F.concat(F.lit('{"white": '), (i % 10).cast("string"), F.lit(', "draws": '), (i % 4).cast("string"),
                    F.when(i % 3 == 0, F.concat(F.lit(', "opening": {"eco": "A'), (i % 9).cast("string"), F.lit('", "name": "Named"}'))).otherwise(""), F.lit("}"))
    return S.normalize_lookup_response(table(spark, sf, "events").select(i.alias("lookup_id"), F.concat(F.lit(early), last).alias("body")))


@query("s9_lookup_cache", """WITH R AS (SELECT event_id % 500 AS state_key, event_id AS saved_at, event_id % 40 - 3 AS total_games FROM events), L AS (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY saved_at DESC) AS n FROM R)
  SELECT state_key, total_games, total_games % 2 = 0 AS ask_again FROM L WHERE n = 1 AND total_games >= 0""")
def s9(spark, sf):
    i = F.col("event_id")
    r = table(spark, sf, "events").select((i % 500).alias("state_key"), i.alias("saved_at"), (i % 40 - 3).alias("total_games"))
    return S.load_lookup_cache(r.withColumn("top_games", F.when(F.col("total_games") % 2 != 0, F.array(F.lit("g"))))).select("state_key", "total_games", "ask_again")


@query("s11_game_text", f"""WITH {G} SELECT stream_id, '[Event "' || CAST(stream_id AS VARCHAR) || '"]' || chr(10) || chr(10) || string_agg(CAST(seq + 1 AS VARCHAR) || '. m' || move || ' {{ [%clk 0:00:0' || move || '] }}', ' ' ORDER BY seq) || ' *' AS value FROM G GROUP BY stream_id""")
def s11(spark, sf):
    m = game(spark, sf).select("stream_id", F.col("seq").alias("order_key"), F.lit(0).alias("depth"), F.lit(0).alias("opens"), F.lit(0).alias("closes"), F.format_string("%d.", F.col("seq") + 1).alias("number"),
                               F.concat(F.lit("m"), "move").alias("move"), F.lit(None).cast("string").alias("eval"), F.concat(F.lit("0:00:0"), "move").alias("reading"))
    tags = m.select("stream_id").distinct().select("stream_id", F.lit(0).alias("pos"), F.lit("Event").alias("key"), F.col("stream_id").cast("string").alias("value"))
    return S.game_text(m, tags)


@query("s12_export_cues", f"""WITH {G}, C AS (SELECT stream_id, seq, CAST(seq * 2 AS DOUBLE) AS s, lead(seq * 2) OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM G)
  SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS INT) AS cue, s AS seconds, CAST(coalesce(least(s + 5, n), s + 5) AS DOUBLE) AS cue_end FROM C""")
def s12(spark, sf):
    g = game(spark, sf)
    c = g.select("stream_id", "seq", (F.col("seq") * 2).cast("double").alias("seconds"), F.lit(False).alias("rollback"), F.col("move").alias("text"))
    return S.export_cues(g.select("stream_id").distinct(), c).select("stream_id", "cue", "seconds", "cue_end")


@query("s13_state_durations", f"""WITH {G}, D AS (SELECT stream_id, seq, coalesce(lead(seq * 2) OVER (PARTITION BY stream_id ORDER BY seq), 10) - seq * 2 AS d, lead(seq) OVER (PARTITION BY stream_id ORDER BY seq) IS NULL AS l FROM G) SELECT stream_id, seq, CAST(d AS DOUBLE) AS duration FROM D WHERE d > 0 OR l""")
def s13(spark, sf):
    g = game(spark, sf).select("stream_id", "seq", (F.col("seq") * 2).cast("double").alias("seconds"), F.lit(10.0).alias("end_seconds"))
    return S.export_state_durations(g).select("stream_id", "seq", "duration")


@query("v1_timeline_invariants", f"""WITH {G}, S AS (SELECT * FROM G WHERE stream_id % 5 <> 0), N AS (SELECT stream_id, count(*) AS n, max(seq) AS last FROM G GROUP BY stream_id)
  SELECT * FROM (SELECT 'count' AS finding, count(*) AS n FROM N WHERE stream_id % 5 = 0 UNION ALL SELECT 'provenance', count(*) FROM G WHERE seq = 2 UNION ALL SELECT 'root_differs', count(*) FROM G WHERE seq = 0) WHERE n > 0""")
def v1(spark, sf):
    g = game(spark, sf)
    states = g.select("stream_id", "seq", "state").unionByName(g.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"), F.lit("end x - - 9").alias("state")).filter("stream_id % 5 <> 0"))
    t = g.withColumn("provenance", F.when(F.col("seq") == 2, "direct").otherwise("missing")).withColumn("reading", F.lit(None).cast("string"))
    # A branch at its root, one whose root is inside it, and one whose root is nowhere.
    b = g.filter("seq BETWEEN 1 AND 2").select("stream_id", F.lit(1).alias("branch_id"), F.lit(1).alias("parent_seq"), (F.col("seq") - 1).alias("step"), "state")
    b = b.unionByName(g.filter("seq = 2").select("stream_id", F.lit(2).alias("branch_id"), F.lit(0).alias("parent_seq"), F.lit(0).cast("long").alias("step"), "state"))
    b = b.unionByName(g.filter("seq = 0").select("stream_id", F.lit(3).alias("branch_id"), F.lit(0).alias("parent_seq"), F.lit(0).cast("long").alias("step"), F.lit("nowhere x - - 1").alias("state")))
    return C.timeline_invariants(t, states, b).groupBy("finding").agg(F.count("*").alias("n"))


@query("a33_a35_branch_rules", f"""WITH {BR}, H AS (SELECT stream_id, branch_id, count(*) AS n, max(score) AS s FROM B GROUP BY ALL), K AS (SELECT stream_id, branch_id FROM H WHERE n > 1 OR s >= 95)
  SELECT B.stream_id, B.branch_id, step, CASE WHEN B.branch_id % 4 = 0 AND NOT (step = 2 AND B.branch_id % 8 = 0) THEN 'r' || CAST(step % 2 AS VARCHAR) END AS reading FROM B JOIN K ON K.stream_id = B.stream_id AND K.branch_id = B.branch_id""")
def a33(spark, sf):
    _, b = branch_tables(spark, sf)
    kept = B.stable_single_step(b.withColumn("lifetime", F.lit(1.0)), 95)
    r = kept.withColumn("reading", F.when((F.col("branch_id") % 4 == 0) | (F.col("step") > 0), F.concat(F.lit("r"), (F.col("step") % 2).cast("string")))).withColumn("terminal", F.col("branch_id") % 8 == 0)
    return B.clear_unread_branch_readings(r).select("stream_id", "branch_id", "step", "reading")


@query("a34_postgame_replay", f"""WITH {BR}, M AS (SELECT stream_id, max(t) AS t_end, max(seq) AS last FROM G WHERE seq < 3 GROUP BY stream_id), H AS (SELECT stream_id, branch_id, min(t) AS s, min(parent_seq) AS p FROM B WHERE branch_id % 4 = 0 GROUP BY ALL),
  D AS (SELECT H.stream_id, branch_id FROM H JOIN M ON M.stream_id = H.stream_id AND s > t_end + 1 AND p <= last) SELECT DISTINCT stream_id, branch_id FROM B WHERE NOT EXISTS (SELECT 1 FROM D WHERE D.stream_id = B.stream_id AND D.branch_id = B.branch_id)""")
def a34(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.postgame_replay_filter(b.withColumn("replay", F.col("branch_id") % 4 == 0), g.filter("seq < 3")).select("stream_id", "branch_id").distinct()


@query("j8_known_roots", f"""WITH {BR}, M AS (SELECT DISTINCT stream_id, split_part(state, ' ', 1) || split_part(state, ' ', 2) AS key FROM G WHERE seq % 3 <> 0), P AS (SELECT stream_id, seq, t FROM G WHERE seq % 3 <> 0),
  H AS (SELECT stream_id, branch_id, arg_min(state, step) AS root, min(parent_seq) AS p, min(t) AS s FROM B GROUP BY ALL HAVING count(*) = 1), D AS (SELECT H.stream_id, branch_id FROM H LEFT JOIN P ON P.stream_id = H.stream_id AND P.seq = p
  WHERE s > coalesce(P.t, 0) + 5 AND NOT EXISTS (SELECT 1 FROM M WHERE M.stream_id = H.stream_id AND M.key = split_part(root, ' ', 1) || split_part(root, ' ', 2)))
  SELECT DISTINCT stream_id, branch_id FROM B WHERE NOT EXISTS (SELECT 1 FROM D WHERE D.stream_id = B.stream_id AND D.branch_id = B.branch_id)""")
def j8(spark, sf):
    g, b = branch_tables(spark, sf)
    return B.known_root_filter(b, g.filter("seq % 3 <> 0"), 5).select("stream_id", "branch_id").distinct()


@query("j4_most_recent", f"""WITH {V}, P AS (SELECT a.stream_id, a.observation_id, b.seq AS h_seq, list_max(list_transform(range(1, 65), lambda i: abs(a.cells[i] - b.cells[i]))) AS m, list_sum(list_transform(range(1, 65), lambda i: abs(a.cells[i] - b.cells[i]))) / 64 AS diff
  FROM V a JOIN V b ON a.stream_id = b.stream_id AND b.seq < a.seq - 1) SELECT stream_id, observation_id, max(h_seq) AS h_seq FROM P WHERE m < 15 AND diff < 3.5 GROUP BY ALL""")
def j4r(spark, sf):
    v = vectors(spark, sf)
    return similar_state_join(v, v, radius=2, mode="most_recent").select("stream_id", "observation_id", "h_seq")
