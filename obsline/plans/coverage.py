"""Queries for sources S1-S6, S10, S15, S16, scalars F3-F34, records P16-P22, counters A25, sets U2 and replays ST2, ST16."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsline.functions import rules as R
from obsline.functions import scalars as S
from obsline.operators import evidence as X
from obsline.plans.base import E, T, events, query, rounded, table, trace
from obsline.plans.flows import frames
from obsline.plans.matching import REPORTS, RUNS, reports, two_runs
from obsline.sources import tables as IO
from obsline.sources.shared import shared_path
from obsline.streaming import run as ST

# ---- sources: each query writes its table in the format, then reads it


def written_events(spark, sf):
    t = trace(spark, sf)
    return t.select(
        F.lit(1).alias("schema_version"), "sequence", "observation_id", "candidate_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.col("observation_id").alias("active_ply"), "event", F.col("move").alias("best_move"), F.col("score").alias("best_score"), F.col("k").cast("double").alias("max_square_diff"),
        (F.col("k") / 7).alias("from_yellowness"), (F.col("k") / 9).alias("to_yellowness"), F.col("state").alias("fen"), F.concat(F.lit("k="), F.col("k").cast("string")).alias("metadata"))


@query("s1_read_events", f"""WITH {T} SELECT CASE WHEN k = 7 THEN 'malformed' ELSE event END AS kind, count(*) AS n, CAST(sum(CASE WHEN k = 7 THEN 0 ELSE observation_id END) AS BIGINT) AS ids FROM T GROUP BY ALL""")
def s1(spark, sf):
    e = written_events(spark, sf)
    line = F.when(F.col("metadata") == "k=7", F.concat(F.lit('{"sequence": '), F.col("sequence").cast("string"), F.lit(", broken"))).otherwise(F.to_json(F.struct(*e.columns)))
    path = shared_path(spark, "events")
    e.select(line.alias("value")).unionByName(spark.range(3).select(F.lit("  ").alias("value"))).write.text(path)
    good, bad = IO.read_events(spark, path)
    rows = good.select(F.col("event").alias("kind"), F.col("observation_id").alias("id")).unionByName(bad.select(F.lit("malformed").alias("kind"), F.lit(0).cast("long").alias("id")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("s2_write_events", f"WITH {T} SELECT sequence, event, candidate_id, round(score, 6) AS best_score, move AS best_move FROM T")
def s2(spark, sf):
    path = shared_path(spark, "events")
    IO.write_events(written_events(spark, sf), path)
    return rounded(IO.read_events(spark, path)[0].select("sequence", "event", "candidate_id", "best_score", "best_move"), digits=6)


@query("s3_trace_tsv", f"""WITH {T} SELECT observation_id AS active_ply, event, CAST(k AS DOUBLE) AS max_square_diff, state AS fen FROM T WHERE epoch_us(ts) / 1000000 BETWEEN 1704067200 + 86400 AND 1704067200 + 20 * 86400""")
def s3(spark, sf):
    path = shared_path(spark, "trace")
    IO.write_trace_tsv(written_events(spark, sf), path, 1704067200 + 86400, 1704067200 + 20 * 86400)
    return IO.read_trace_tsv(spark, path).select("active_ply", "event", "max_square_diff", "fen")


@query("s4_read_observations", f"""WITH {E}, R AS (SELECT observation_id AS id, k, k * 31.5 AS t FROM E) SELECT CASE WHEN k % 3 > 0 THEN id ELSE CAST(floor(t / 60) AS BIGINT) * 4294967296 + CAST(round(t * 1000) AS BIGINT) END AS observation_id, CAST(floor(t / 60) AS INT) AS chunk,
  CASE WHEN k % 5 = 0 THEN 'replay' ELSE 'r' || CAST(k % 5 AS VARCHAR) END AS reason, CASE WHEN k % 11 = 0 THEN 'cells' END AS quarantine, count(*) AS n FROM R GROUP BY ALL""")
def s4(spark, sf):
    e, path = events(spark, sf), shared_path(spark, "observations")
    cells = F.transform(F.sequence(F.lit(1), F.when(F.col("k") % 11 == 0, 3).otherwise(64)), lambda i: i.cast("double"))
    e.select("stream_id", F.when(F.col("k") % 3 > 0, F.col("observation_id")).alias("observation_id"), (F.col("k") * 31.5).alias("timestamp"),
             F.when(F.col("k") % 5 > 0, F.concat(F.lit("r"), (F.col("k") % 5).cast("string"))).alias("emission_reason"), cells.alias("cells")).write.json(path)
    return IO.read_observations(spark, path).groupBy("observation_id", "chunk", "reason", "quarantine").agg(F.count("*").alias("n"))


@query("s5_compact_observations", f"WITH {T} SELECT stream_id, CAST(candidate_id AS BIGINT) AS observation_key, CAST(count(*) AS BIGINT) AS events FROM T GROUP BY ALL")
def s5(spark, sf):
    path = shared_path(spark, "compact")
    IO.write_compact_observations(X.compact_observations(trace(spark, sf).withColumn("observation_id", F.col("candidate_id").cast("long")), ["state"], ["event"]), path)
    return spark.read.json(path).select("stream_id", "observation_key", F.size("events").cast("long").alias("events"))


@query("s6_read_labels", """SELECT CAST(doc_id AS VARCHAR) AS transition_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS truth, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS measures, CASE WHEN doc_id % 3 = 0 THEN doc_id / 2.0 END AS pair_score
  FROM labels WHERE doc_id % 5 > 0 AND quality IS NOT NULL""")
def s6(spark, sf):
    i, path = F.col("doc_id"), shared_path(spark, "labels")
    rows = table(spark, sf, "labels").filter("quality IS NOT NULL").select(
        F.when(i % 5 > 0, "yellow").alias("detector"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("truth"), F.coalesce(F.col("toxic").cast("string"), F.lit("none")).alias("prediction"),
        i.cast("string").alias("transition_id"), (i * 1.5).alias("origin_score"), F.when(i % 3 == 0, i / 2).alias("pair_score"))
    rows.write.json(path)
    return IO.read_labels(spark, path).select("transition_id", "truth", F.size("measures").alias("measures"), F.col("measures")["pair_score"].alias("pair_score"))


@query("s6_free_measures", """SELECT CAST(doc_id AS VARCHAR) AS transition_id, CAST(1 + (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT AS INT) AS measures, CASE WHEN doc_id % 2 = 0 THEN doc_id / 4 END AS drift, CASE WHEN doc_id % 7 = 0 THEN 'note' END AS note
  FROM labels WHERE quality IS NOT NULL""")
def s6_free(spark, sf):
    """Label rows with numeric fields that no schema names, texts and nested values beside them."""
    i, path = F.col("doc_id"), shared_path(spark, "measures")
    rows = table(spark, sf, "labels").filter("quality IS NOT NULL").select(
        F.lit("hover").alias("detector"), F.lit("yes").alias("truth"), F.lit("no").alias("prediction"), i.cast("string").alias("transition_id"), (i / 8).alias("score"), F.when(i % 7 == 0, "note").alias("note"),
        F.when(i % 2 == 0, i / 4).alias("drift_px"), i.alias("frame no"), F.when(i % 3 == 0, i.cast("int")).alias("retries"), F.struct(F.lit(1).alias("x")).alias("box"))
    rows.write.json(path)
    read = IO.read_labels(spark, path)
    return read.select("transition_id", F.size("measures").alias("measures"), F.col("measures")["drift_px"].alias("drift"), F.try_variant_get("record", "$.note", "string").alias("note"))


@query("s10_read_templates", """SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'n' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE lower(n_name) || ',x' END AS keywords, n_nationkey % 2 = 0 AS built_in FROM nation""")
def s10(spark, sf):
    k, path = F.col("n_nationkey"), shared_path(spark, "templates")
    one = F.struct(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.when(k % 4 > 0, F.col("n_name")).alias("name"), F.when(k % 3 > 0, F.array(F.lower("n_name"), F.lit("x"))).alias("keywords"),
                   F.when(k % 2 == 0, True).alias("isBuiltIn"), F.create_map(F.lit("size"), k.cast("string")).alias("config"))
    # One file of layouts for each region.
    table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("n_regionkey").text(path)
    return IO.read_templates(spark, path).select("id", "name", F.array_join("keywords", ",").alias("keywords"), "built_in")


@query("s15_read_frames", """SELECT vec_id AS observation_id, 32 AS height, 16 AS width, CAST(32 * 16 * 3 AS INT) AS bytes, CAST(least(greatest(floor((embedding[61] + 0.5) * 255), 0), 255) AS INT) AS first FROM embeddings""")
def s15(spark, sf):
    path = shared_path(spark, "frames")
    frames(spark, sf).write.parquet(path)
    cut = IO.crop_frames(IO.read_frames(spark, path).withColumns({"x": F.lit(16), "y": F.lit(0), "w": F.lit(16), "h": F.lit(32)}))
    return cut.select("observation_id", "height", "width", F.length("pixels").alias("bytes"), F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("int").alias("first"))


@query("s16_diagnostic_bundle", f"""WITH {T}, {REPORTS}, M AS (SELECT report_id, T.* FROM T JOIN Q ON T.stream_id = Q.stream_id AND ts BETWEEN start AND stop)
  SELECT report_id, 'report' AS part, 1 AS n FROM Q UNION ALL SELECT report_id, 'events', count(*) FROM M GROUP BY ALL UNION ALL SELECT report_id, 'observations', count(DISTINCT candidate_id) FROM M GROUP BY ALL
  UNION ALL SELECT report_id, 'summary', count(DISTINCT event) FROM M GROUP BY ALL""")
def s16(spark, sf):
    t = trace(spark, sf)
    compact = t.select("stream_id", F.col("candidate_id").alias("observation_key"), "ts", "state")
    bundle = IO.diagnostic_bundle(t, reports(spark, sf), compact)
    path = shared_path(spark, "bundle")
    IO.write_bundle(bundle, path)
    return IO.read_bundle(spark, path).groupBy("report_id", "part").agg(F.count("*").alias("n"))


# ---- scalars

_MS = "CAST({0} // 60 AS VARCHAR) || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"


def _ms(seconds):
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


@query("f3_f5_readings", f"""WITH {E}, R AS (SELECT observation_id, k, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(k % 10 AS VARCHAR) WHEN 2 THEN CAST(k % 10 AS VARCHAR) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') ELSE CAST(10 + k % 50 AS VARCHAR) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') END AS r,
  60 + k % 100 AS p, greatest(60 + k % 100 + k % 7 * 20 - 40, 0) AS c FROM E), Q AS (SELECT *, list_filter([c + 3, p - 10, p + 10], lambda s: s <= p + 65) AS fit, c <= p + 65 AS sound FROM R),
  B AS (SELECT *, list_max(list_filter(fit, lambda s: s > c AND s - c <= 5)) AS above, list_max(list_filter(fit, lambda s: s < 120)) AS low,
  list_sort(list_transform(fit, lambda s: {{'d': abs(s - p), 'r': {_MS.format('s')}}}))[1].r AS nearest FROM Q)
  SELECT observation_id, CASE k % 4 WHEN 0 THEN '0:00:00' WHEN 1 THEN '0:00:0' || r WHEN 2 THEN '0:0' || r ELSE '0:' || r END AS padded, CASE WHEN k % 2 = 0 THEN CAST(k % 10 AS VARCHAR) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') END AS recovered,
  CASE WHEN sound AND c > p AND c < 120 THEN coalesce({_MS.format('above')}, {_MS.format('c')}) WHEN sound THEN {_MS.format('c')} WHEN p < 120 AND low IS NOT NULL THEN {_MS.format('low')} ELSE coalesce(nearest, {_MS.format('c')}) END AS chosen FROM B""")
def f3(spark, sf):
    k = F.col("k")
    two = F.lpad((k % 60).cast("string"), 2, "0")
    text = F.when(k % 4 == 0, "").when(k % 4 == 1, (k % 10).cast("string")).when(k % 4 == 2, F.concat_ws(":", (k % 10).cast("string"), two)).otherwise(F.concat_ws(":", (10 + k % 50).cast("string"), two))
    smeared = F.concat(F.when(k % 2 == 0, "1:1").otherwise("2:1"), (k % 10).cast("string"), F.lit(":"), two)
    was = 60 + k % 100
    now = F.greatest(was + k % 7 * 20 - 40, F.lit(0))
    return events(spark, sf).select("observation_id", S.pad_reading(text).alias("padded"), S.recover_suffix(smeared).alias("recovered"),
                                    S.choose_reading(F.array(_ms(now + 3), _ms(was - 10), _ms(was + 10)), _ms(now), _ms(was)).alias("chosen"))


@query("f7_f15_states", f"""WITH {E}, N AS (SELECT *, 1 + k % 6 AS m FROM E) SELECT observation_id, CAST(1 + k % 40 AS VARCHAR) || CASE WHEN side = 'b' THEN '...' ELSE '.' END AS number, 'p' || repeat('.', m) || repeat('N', 7 - m) || repeat('.', 48) || 'Rnbq.K..' AS cells,
  CAST(1 + 7 - m + 5 AS INT) AS occupied, CAST(3 * (7 - m) - 1 + 5 - 3 - 3 - 9 AS INT) AS material, CAST(CASE WHEN side = 'b' THEN -1 ELSE 1 END * CASE WHEN k % 10 = 0 AND k > 50 THEN 15000 WHEN k % 10 = 0 THEN -15000 ELSE k * 7 - 300 END AS INT) AS view FROM N""")
def f7(spark, sf):
    k = F.col("k")
    n = 1 + k % 6
    state = F.concat(F.lit("p"), n.cast("string"), F.expr("repeat('N', 7 - (1 + k % 6))"), F.lit("/8/8/8/8/8/8/Rnbq1K2 "), F.col("side"), F.lit(" - - 0 "), (1 + k % 40).cast("string"))
    e = events(spark, sf).withColumn("fen", state)
    s = F.col("fen")
    return e.select("observation_id", S.move_number(s).alias("number"), F.array_join(S.expand_cells(s), "").alias("cells"), S.occupied_cells(s).alias("occupied"), S.material(s).alias("material"),
                    S.white_view(k * 7 - 300, F.when(k % 10 == 0, k - 50), s).alias("view"))


@query("f13_f19_lines", f"""WITH {E}, N AS (SELECT *, CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END AS sign, k % 5 AS rank, k * 5 AS gap FROM E), C AS (SELECT *, 1 - least(greatest((gap - 10) / 170.0, 0.0), 1.0) AS near, rank = 0 OR gap <= 10 AS lead FROM N)
  SELECT observation_id, CASE WHEN k % 10 = 3 THEN CASE WHEN (k - 50) * sign > 0 THEN '+M' ELSE '-M' END || CAST(abs(k - 50) AS VARCHAR) ELSE printf('%+.2f', (k * 7 - 300) * sign / 100.0) END AS text, CAST(floor(value * 100 + 0.5) / 100.0 AS DOUBLE) AS rounded,
  CAST(CASE WHEN lead THEN 16 ELSE least(greatest(floor(16 * (0.42 + 0.58 * near) + 0.5), 5), 16) END AS INT) AS thickness,
  round(least(greatest(CASE WHEN lead THEN 0.48 WHEN rank = 1 THEN 0.34 WHEN rank = 2 THEN 0.26 ELSE 0.20 END * CASE WHEN gap > 80 THEN 1 - least((gap - 80) / 240.0, 1.0) * 0.35 ELSE 1.0 END, 0.14), 0.48), 9) AS opacity FROM C""")
def f13(spark, sf):
    k = F.col("k")
    style = S.line_style(k % 5, k * 5)
    return events(spark, sf).select("observation_id", S.evaluation_text(k * 7 - 300, F.when(k % 10 == 3, k - 50), k % 2 == 1).alias("text"), S.round_time(F.col("value")).alias("rounded"),
                                    style["thickness"].alias("thickness"), F.round(style["opacity"], 9).alias("opacity"))


@query("f20_f29_texts", f"""WITH {E} SELECT observation_id, 'e2e4' AS move, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE '??' END AS annotation, 'one two' AS tokens, CAST(k AS VARCHAR) || '|' || event_type AS key,
  CASE WHEN k % 7 = 0 OR k < 8 THEN 1.0 ELSE round(least(greatest(1 - (k / 80 - 0.1), 0.0), 1.0), 9) END AS uncertainty, CASE k % 3 WHEN 0 THEN 'a+b+c' WHEN 1 THEN 'x+y' ELSE 'unspecified' END AS conditions, 'a=' || CAST(k AS VARCHAR) AS meta FROM E""")
def f20(spark, sf):
    k = F.col("k")
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), k % len(x))
    cut = S.split_annotation(F.concat(F.lit("e2e4"), pick("", "!", "??")))
    meta = S.metadata_map(F.concat(F.lit("a="), k.cast("string"), F.lit(";ts=5")), ("ts",))
    return events(spark, sf).select(
        "observation_id", cut["move"].alias("move"), cut["annotation"].alias("annotation"), S.first_tokens(F.lit(" one  two three "), 2).alias("tokens"), S.cache_key(k.cast("string"), F.col("event_type")).alias("key"),
        F.round(S.uncertainty(F.when(k % 7 > 0, k / 80 - 0.1)), 9).alias("uncertainty"), F.array_join(S.condition_list(pick("a, b,,c", '["x"," y "]', "")), "+").alias("conditions"),
        F.array_join(F.transform(F.map_entries(meta), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("meta"))


@query("f24_content_hash", f"WITH {E} SELECT k, event_type, count(*) AS n FROM E GROUP BY ALL")
def f24(spark, sf):
    found = events(spark, sf).groupBy(S.content_hash(F.col("k"), F.col("event_type")).alias("h")).agg(F.min("k").alias("k"), F.min("event_type").alias("event_type"), F.count("*").alias("n"))
    return found.drop("h")


@query("f31_f34_records", f"""WITH {E}, R AS (SELECT *, 100 + k AS x, 50 + k AS y, 80 + k AS w, 90 AS h, 11 AS c FROM E) SELECT observation_id, CASE k % 4 WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' WHEN 2 THEN '1/2-1/2' ELSE '*' END AS result,
  greatest(0, CAST(trunc(x + w * 0.70) AS INT)) AS x1, least(220, CAST(x + w AS INT)) AS x2, greatest(0, CAST(trunc(y - c * 0.55) AS INT)) AS top_y1, greatest(greatest(0, CAST(trunc(y - c * 0.55) AS INT)) + 1, CAST(trunc(y - c * 0.08) AS INT)) AS top_y2,
  least(199, CAST(trunc(y + h + c * 0.18) AS INT)) AS bottom_y1, least(200, CAST(trunc(y + h + c * 0.58) AS INT)) AS bottom_y2, CASE WHEN k % 3 = 0 THEN k WHEN abs(k - k * 37 % 90) <= 65 THEN least(k, k * 37 % 90) ELSE k END AS lower_reading FROM R""")
def f31(spark, sf):
    k = F.col("k")
    g = F.struct((100 + k).alias("x"), (50 + k).alias("y"), (80 + k).alias("width"), F.lit(90).alias("height"), F.lit(11).alias("square_height"))
    e = events(spark, sf).withColumn("g", g)
    winner = F.get(F.array(*map(F.lit, ("white", "black", "draw", ""))), k % 4)
    return e.select("observation_id", S.result_text(winner).alias("result"), S.region_bounds(F.col("g"), F.lit(220), F.lit(200)).alias("b"), S.lower_plausible(k, F.when(k % 3 > 0, k * 37 % 90)).alias("lower_reading")).select(
        "observation_id", "result", "b.*", "lower_reading")


@query("p16_p22_records", f"""WITH {T} SELECT observation_id, CAST(stream_id AS VARCHAR) || ':' || event || ':' || lpad(CAST(k AS VARCHAR), 8, '0') AS record_id, CAST(CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS INT) AS fields, CAST(stream_id AS VARCHAR) || ':' || lpad(CAST(k AS VARCHAR), 8, '0') AS decision_id,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'motion_spike,' END || CASE WHEN k % 2 = 0 THEN 'active' ELSE 'idle' END || CASE WHEN k % 7 > 2 THEN ',multi_cell' WHEN k % 7 = 0 THEN ',quiet' ELSE '' END || CASE WHEN k % 5 = 0 THEN '' ELSE ',spike' END AS tags,
  k % 2 = 0 AND k % 3 = 2 AND k % 5 >= 2 AND k % 7 >= 2 AS reliable, CAST(CASE WHEN k % 9 > 1 THEN greatest(k - 20.0, 0) END AS DOUBLE) AS seconds FROM T""")
def p16(spark, sf):
    k, t = F.col("k"), trace(spark, sf)
    fields = F.create_map(F.lit("a"), k.cast("string"), F.lit("b"), F.when(k % 4 > 0, "x").otherwise(""))
    record = R.provenance_record(F.col("stream_id"), F.col("event"), k, fields)
    tags = R.observation_tags(F.when(k % 5 > 0, "motion_spike").otherwise(""), k % 2 == 0, k % 7)
    times = F.when(k % 9 == 0, float("nan")).when(k % 9 == 1, float("inf")).otherwise(k - 20.0)
    return t.select("observation_id", record["record_id"].alias("record_id"), F.size(record["fields"]).alias("fields"), R.decision_record(F.col("stream_id"), F.col("event"), k, F.lit("x"), F.lit("y"))["decision_id"].alias("decision_id"),
                    F.array_join(tags, ",").alias("tags"), R.veto_reliable(k % 2 == 0, k % 3, k % 5, k % 7).alias("reliable"), R.finite_only(times).alias("seconds"))


# ---- the quality report

def flat_evidence(spark, sf):
    """A trace with the evidence fields that the quality report counts."""
    k = F.col("k")
    pick = lambda *x: F.get(F.array(*(F.lit(v) for v in x)), k % len(x))
    some = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return trace(spark, sf).withColumns({
        "yellow_checked": k % 2 == 0, "clock_checked": k % 3 == 0, "hover_checked": k % 5 == 0, "hover_detected": k % 10 == 0, "yellow_decision": pick("passed", "", "ambiguous"), "clock_decision": pick(None, "turn_match"), "template_identity": pick("t1", "t2", None),
        "changed_squares": some(k % 3), "clock_candidates": some(k % 4), "yellow_from": k * 0.5, "localization_score": k - 20.0, "localization_confidence": k / 50, "score_margin": k * 0.3, "legal_candidates": k % 4, "clock_top_width": k % 2, "clock_top_bright_ratio": k / 10})


@query("a11_quality_counters", f"""WITH {T} SELECT stream_id, count(*) AS records, count(*) FILTER (k % 2 = 0) AS yellow_checked, count(*) FILTER (k % 3 = 0) AS clock_checked, count(*) FILTER (k % 5 = 0) AS hover_checked, count(*) FILTER (k % 10 = 0) AS hover_detected, count(*) FILTER (k % 3 > 0) AS with_changed_squares,
  count(*) FILTER (k % 4 > 0) AS with_clock_candidates, CAST(sum(k % 3) AS BIGINT) AS entries_changed_squares, CAST(sum(k % 4) AS BIGINT) AS entries_clock_candidates, count(*) FILTER (k < 20) AS localization_unavailable, count(*) FILTER (k % 4 > 0 AND k * 0.3 < 10) AS low_score_margin, count(*) FILTER (k % 2 > 0) AS clock_regions_measured FROM T GROUP BY stream_id""")
def a11c(spark, sf):
    return X.quality_counters(flat_evidence(spark, sf), "stream_id")


@query("a11_quality_choices", f"""WITH {T}, U AS (SELECT 'yellow_decision' AS field, ['passed', '', 'ambiguous'][k % 3 + 1] AS value FROM T UNION ALL SELECT 'clock_decision', [NULL, 'turn_match'][k % 2 + 1] FROM T UNION ALL SELECT 'template_identity', ['t1', 't2', NULL][k % 3 + 1] FROM T)
  SELECT field, value, count(*) AS n FROM U WHERE value <> '' GROUP BY ALL""")
def a11d(spark, sf):
    return X.quality_choices(flat_evidence(spark, sf))


@query("a11_quality_numbers", f"""WITH {T}, U AS (SELECT 'yellow_from' AS measure, k * 0.5 AS v FROM T WHERE k % 2 = 0 UNION ALL SELECT 'localization_score', k - 20.0 FROM T WHERE k >= 20 UNION ALL SELECT 'localization_confidence', k / 50 FROM T WHERE k <= 50 UNION ALL SELECT 'score_margin', k * 0.3 FROM T WHERE k % 4 > 0
  UNION ALL SELECT 'clock_top_bright_ratio', k / 10 FROM T WHERE k % 2 > 0) SELECT measure, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM U GROUP BY measure""")
def a11n(spark, sf):
    return rounded(X.quality_numbers(flat_evidence(spark, sf)), digits=6)


@query("a11_quality_rejections", f"WITH {T}, P AS (SELECT candidate_id, count(*) AS c FROM T WHERE event = 'VALIDATION_REJECTED' GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS rejected, count(*) AS candidates, CAST(sum(c - 1) AS BIGINT) AS repeated FROM P")
def a11r(spark, sf):
    return X.quality_rejections(trace(spark, sf))


# ---- counters, sets, replays

@query("a25_run_counters", f"WITH {T} SELECT count(*) AS rows, count(*) FILTER (event = 'ACCEPT') AS accepts, CAST(sum(k) AS BIGINT) AS total FROM T")
def a25(spark, sf):
    counted, seen = X.run_counters(trace(spark, sf), "counters", accepts=F.count_if(F.col("event") == "ACCEPT"), total=F.sum("k"))
    counted.write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([(found["rows"], found["accepts"], found["total"])], "rows long, accepts long, total long")


@query("u2_multiset_equal", f"""WITH {RUNS}, D AS ((SELECT observation_id, state FROM T EXCEPT ALL SELECT observation_id, state FROM B) UNION ALL (SELECT observation_id, state FROM B EXCEPT ALL SELECT observation_id, state FROM T))
  SELECT true AS same, (SELECT count(*) FROM D) = 0 AS changed_same""")
def u2(spark, sf):
    a, b = (d.select("observation_id", "state") for d in two_runs(spark, sf))
    return spark.createDataFrame([(X.multiset_equal(a, a.repartition(3)), X.multiset_equal(a, b))], "same boolean, changed_same boolean")


@query("st2_st16_bounded_replay", "SELECT user_id AS stream_id, event_id AS observation_id, event_type FROM events")
def st16(spark, sf):
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*")
    rows = ST.watermarked(stream.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("observation_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type"), "1 hour")
    path = shared_path(spark, "replay")
    ST.bounded_replay(ST.dedup_observations(rows), f"{path}/rows", f"{path}/log")
    return spark.read.parquet(f"{path}/rows").select("stream_id", "observation_id", "event_type")
