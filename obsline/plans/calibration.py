"""Queries over label rows: A1-A18, A28, J18, T3."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsline.operators import metrics as M
from obsline.plans.base import COUNTS, RATES, L, labels, query, rounded

SWEEP = f"""{L}, S AS (SELECT score, count(*) FILTER (truth = 'positive') AS p, count(*) FILTER (truth = 'negative') AS q FROM L WHERE truth <> 'uncertain' GROUP BY score),
W AS (SELECT score AS threshold, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(q) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
  CAST(sum(p) OVER () AS BIGINT) AS pos, CAST(sum(q) OVER () AS BIGINT) AS neg FROM S),
O AS (SELECT threshold, tp, neg - fp AS tn, fp, pos - tp AS fn, pos + neg AS labeled FROM W)"""


@query("a1_confusion_metrics", f"WITH {L}, C AS (SELECT detector, {COUNTS} FROM L GROUP BY detector) SELECT *, {RATES} FROM C")
def a1(spark, sf):
    return rounded(M.confusion_metrics(labels(spark, sf), "detector"))


@query("a2_confidence_bins", f"""WITH {L}, B AS (SELECT least(CAST(floor(confidence * 10) AS INT), 9) AS bin, confidence, CAST(truth = prediction AS INT) AS ok FROM L
  WHERE truth <> 'uncertain' AND prediction <> 'uncertain' AND confidence BETWEEN 0 AND 1)
  SELECT CAST(i AS INT) AS bin, i / 10 AS lower, (i + 1) / 10 AS upper, count(bin) AS n, round(avg(confidence), 9) AS mean_confidence, round(avg(ok), 9) AS observed_accuracy
  FROM range(10) r(i) LEFT JOIN B ON B.bin = i GROUP BY i""")
def a2(spark, sf):
    return rounded(M.confidence_bins(labels(spark, sf)))


_SETS = f"""WITH {L}, D AS (SELECT *, unnest([('overall', 'all'), ('regime', regime), ('component', component), ('case', "case"), ('condition', regime), ('condition', component)]) AS x FROM L),
  C AS (SELECT detector, x[1] AS dimension, x[2] AS value, {COUNTS} FROM D GROUP BY ALL) SELECT *, {RATES} FROM C"""


@query("a3_metrics_by_dimension", _SETS)
def a3(spark, sf):
    return rounded(M.metrics_by_dimension(labels(spark, sf)))


@query("a4_collapse_transitions", f"""WITH {L} SELECT transition_id, CASE WHEN min(truth) = max(truth) THEN min(truth) ELSE 'uncertain' END AS truth,
  CASE WHEN min(prediction) = max(prediction) THEN min(prediction) ELSE 'uncertain' END AS prediction,
  round(avg(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END), 9) AS confidence FROM L GROUP BY transition_id""")
def a4(spark, sf):
    return rounded(M.collapse_transitions(labels(spark, sf)))


def readings(spark, sf):
    """Expected readings from order keys; the selected ones lose or change a digit now and then."""
    from obsline.plans.base import table

    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    expected = F.format_string("%d:%02d:%02d", k % 3, k % 60, (k * 7) % 60)
    selected = F.when(k % 5 == 0, F.format_string("%d:%02d:%02d", k % 3, k % 60, (k * 7 + 1) % 60)).when(k % 7 == 0, "").otherwise(expected)
    return o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("variant"), expected.alias("expected"), selected.alias("selected"), (k % 11 != 0).alias("measured"),
                    F.when(k % 3 == 0, "active_side").when(k % 3 == 1, "white_ocr").otherwise("black_ocr").alias("component"), F.floor(k / 3).alias("image"),
                    F.when(k % 13 == 0, "negative").otherwise("positive").alias("truth"), F.when(k % 17 == 0, "negative").otherwise("positive").alias("prediction"))


R = """R AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS variant, printf('%d:%02d:%02d', o_orderkey % 3, o_orderkey % 60, (o_orderkey * 7) % 60) AS expected,
  CASE WHEN o_orderkey % 5 = 0 THEN printf('%d:%02d:%02d', o_orderkey % 3, o_orderkey % 60, (o_orderkey * 7 + 1) % 60) WHEN o_orderkey % 7 = 0 THEN '' ELSE
  printf('%d:%02d:%02d', o_orderkey % 3, o_orderkey % 60, (o_orderkey * 7) % 60) END AS selected, o_orderkey % 11 <> 0 AS measured,
  CASE o_orderkey % 3 WHEN 0 THEN 'active_side' WHEN 1 THEN 'white_ocr' ELSE 'black_ocr' END AS component, o_orderkey // 3 AS image,
  CASE WHEN o_orderkey % 13 = 0 THEN 'negative' ELSE 'positive' END AS truth, CASE WHEN o_orderkey % 17 = 0 THEN 'negative' ELSE 'positive' END AS prediction FROM orders),
  Q AS (SELECT *, replace(expected, ':', '') AS e, replace(selected, ':', '') AS s FROM R),
  A AS (SELECT *, list_sum(list_transform(range(1, least(length(e), length(s)) + 1), lambda i: CAST(substr(e, i, 1) = substr(s, i, 1) AS INT))) AS same FROM Q),
  P AS (SELECT variant, count(*) FILTER (measured) AS rows, count(*) FILTER (NOT measured) AS unmeasured_rows, CAST(coalesce(sum(same) FILTER (measured), 0) AS BIGINT) AS digit_correct,
  CAST(sum(greatest(length(e), length(s))) FILTER (measured) AS BIGINT) AS digit_total, count(*) FILTER (measured AND expected = selected) AS complete_correct,
  count(*) FILTER (measured AND selected <> '') AS rows_with_reading FROM A GROUP BY variant)"""


@query("a5_reading_accuracy", f"WITH {R} SELECT *, round(digit_correct / digit_total, 9) AS digit_accuracy, round(complete_correct / rows, 9) AS complete_accuracy FROM P")
def a5(spark, sf):
    return rounded(M.reading_accuracy(readings(spark, sf), "variant"))


@query("a6_perturbation_summary", f"""WITH {R}, F AS (SELECT *, digit_correct / digit_total AS d, complete_correct / rows AS c FROM P)
  SELECT variant, rows, unmeasured_rows, digit_correct, digit_total, complete_correct, rows_with_reading, round(d, 9) AS digit_accuracy, round(c, 9) AS complete_accuracy,
  round((SELECT c FROM F WHERE variant = '1'), 9) AS baseline_accuracy, CASE WHEN rows = 0 THEN 'unmeasured' WHEN c < (SELECT c FROM F WHERE variant = '1') - 0.02 THEN 'degraded' ELSE 'stable' END AS status FROM F""")
def a6(spark, sf):
    return rounded(M.perturbation_summary(readings(spark, sf), baseline="1"))


@query("a7_usable_groups", f"""WITH {R}, U AS (SELECT image, CASE WHEN bool_and(truth = 'positive') THEN 'positive' ELSE 'negative' END AS truth,
  CASE WHEN bool_and(CASE WHEN component = 'active_side' THEN prediction = 'positive' ELSE expected = selected END) THEN 'positive' ELSE 'negative' END AS prediction
  FROM R GROUP BY image HAVING count(DISTINCT component) = 3 AND bool_and(measured OR component = 'active_side')) SELECT truth, prediction, count(*) AS n FROM U GROUP BY ALL""")
def a7(spark, sf):
    return M.usable_groups(readings(spark, sf), ["image"]).groupBy("truth", "prediction").agg(F.count("*").alias("n"))


@query("a8_candidate_outcomes", f"""WITH {R}, M AS (SELECT DISTINCT image, variant, CASE WHEN id % 19 = 0 THEN '' ELSE expected END AS e, CASE WHEN measured THEN selected END AS o FROM R),
  X AS (SELECT CASE WHEN o IS NULL THEN 'unmeasured' WHEN e <> '' AND o = '' THEN 'missing_candidate' WHEN e <> '' AND e = o THEN 'exact' WHEN e <> '' THEN 'wrong_candidate'
  WHEN o <> '' THEN 'unexpected_candidate' ELSE 'no_candidate' END AS outcome FROM M) SELECT outcome, count(*) AS n FROM X GROUP BY outcome""")
def a8(spark, sf):
    rows = readings(spark, sf).withColumn("observed", F.when(F.col("measured"), F.col("selected"))).withColumn("expected", F.when(F.col("id") % 19 == 0, "").otherwise(F.col("expected")))
    return M.candidate_outcomes(rows, ["image", "variant"])


@query("a9_numeric_summary", "SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def a9(spark, sf):
    from obsline.plans.base import table

    return rounded(M.numeric_summary(table(spark, sf, "events"), "value", "event_type"), "mean", digits=6)


@query("a10_decision_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY event_type")
def a10(spark, sf):
    from obsline.plans.base import table

    return M.decision_counts(table(spark, sf, "events"), "event_type")


@query("a14_threshold_sweep", f"WITH {SWEEP} SELECT *, {RATES} FROM O")
def a14(spark, sf):
    return rounded(M.threshold_sweep(labels(spark, sf)))


@query("a15_robust_operating_point", f"""WITH {SWEEP}, Z AS (SELECT regime, count(*) FILTER (truth = 'positive') AS pos, count(*) FILTER (truth = 'negative') AS neg FROM L WHERE truth <> 'uncertain' GROUP BY regime),
  H AS (SELECT O.threshold, Z.regime, Z.pos, Z.neg, count(*) FILTER (L.truth = 'positive' AND L.score >= O.threshold) AS tp, count(*) FILTER (L.truth = 'negative' AND L.score >= O.threshold) AS fp
  FROM O CROSS JOIN Z JOIN L ON L.regime = Z.regime WHERE Z.pos + Z.neg >= 5 GROUP BY ALL),
  K AS (SELECT threshold, min(coalesce(tp / nullif(tp + fp, 0), 0)) AS wp, min(coalesce(tp / nullif(pos, 0), 0)) AS wr, max(coalesce(fp / nullif(neg, 0), 0)) AS wf, count(*) AS regime_count FROM H GROUP BY threshold)
  SELECT O.threshold, round(wp, 9) AS worst_precision, round(wr, 9) AS worst_recall, round(wf, 9) AS worst_fpr, regime_count, labeled, round(tp / nullif(tp + fn, 0), 9) AS recall,
  labeled >= 30 AND wp >= 0.95 AND wr >= 0.95 AND wf <= 0.02 AS meets_target, CASE WHEN labeled >= 30 AND wp >= 0.95 AND wr >= 0.95 AND wf <= 0.02 THEN 'pass' WHEN labeled < 30 THEN 'insufficient_data' ELSE 'advisory' END AS status
  FROM O JOIN K ON K.threshold = O.threshold ORDER BY meets_target DESC, wr DESC, wp DESC, wf, coalesce(nullif(tp / nullif(tp + fn, 0), 0), -1) DESC, O.threshold LIMIT 1""")
def a15(spark, sf):
    return rounded(M.robust_operating_point(labels(spark, sf), (30, 0.95, 0.95, 0.02)))


ENDS, PAIRS = [float(e) for e in range(10, 65, 5)], [float(p) for p in range(20, 190, 10)]


@query("a16_threshold_grid", f"""WITH {L}, G AS (SELECT CAST(e AS DOUBLE) AS endpoint, CAST(p AS DOUBLE) AS pair FROM range(10, 65, 5) a(e), range(20, 190, 10) b(p)),
  C AS (SELECT endpoint, pair, count(*) FILTER (truth = 'positive' AND hit) AS tp, count(*) FILTER (truth = 'negative' AND NOT hit) AS tn, count(*) FILTER (truth = 'negative' AND hit) AS fp,
  count(*) FILTER (truth = 'positive' AND NOT hit) AS fn, count(*) AS labeled FROM (SELECT *, least(score, label_id % 100) >= endpoint AND score + label_id % 100 >= pair AS hit FROM G, L WHERE truth <> 'uncertain') GROUP BY ALL) SELECT *, {RATES} FROM C""")
def a16(spark, sf):
    rows = labels(spark, sf).withColumn("origin", F.col("score")).withColumn("target", (F.col("label_id") % 100).cast("double"))
    return rounded(M.threshold_grid(rows, ENDS, PAIRS))


@query("a17_evaluate_target", f"""WITH {L}, C AS (SELECT detector, {COUNTS} FROM L GROUP BY detector), N AS (SELECT detector, labeled, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, fp / nullif(fp + tn, 0) AS f FROM C),
  G(detector, n, gp, gr, gf) AS (VALUES ('yellow', 30, 0.95, 0.95, 0.02), ('clock', 30, 0.98, 0.95, 0.02), ('hover', 30, 0.95, 0.95, 0.03), ('geometry', 30, 0.98, 0.98, 0.01))
  SELECT N.detector, labeled, CASE WHEN labeled < n THEN 'insufficient_data' WHEN coalesce(p, -1) >= gp AND coalesce(r, -1) >= gr AND coalesce(f, 2) <= gf THEN 'pass' ELSE 'fail' END AS status FROM N JOIN G ON G.detector = N.detector""")
def a17(spark, sf):
    return M.evaluate_target(M.confusion_metrics(labels(spark, sf), "detector")).select("detector", "labeled", "status")


@query("a18_coverage", f"""WITH {L}, S AS (SELECT detector, list_sort(list(DISTINCT component) FILTER (component IN ('src0', 'src1', 'src2', 'none'))) AS seen FROM L GROUP BY detector)
  SELECT detector, array_to_string(coalesce(seen, []), ',') AS observed, array_to_string(list_filter(['src0', 'src1', 'src2', 'none'], lambda x: NOT list_contains(coalesce(seen, []), x)), ',') AS missing, 'incomplete' AS status FROM S""")
def a18(spark, sf):
    c = M.coverage(labels(spark, sf), "component", ("src0", "src1", "src2", "none"), "detector")
    return c.select("detector", F.array_join("observed", ",").alias("observed"), F.array_join("missing", ",").alias("missing"), "status")


@query("a28_measurement_report", f"""WITH {L}, M AS (SELECT regime, unnest([('score', score), ('confidence', confidence)]) AS x FROM L)
  SELECT regime, x[1] AS measure, count(*) AS n, round(avg(x[2]), 6) AS mean, round(quantile_disc(x[2], 0.5), 6) AS median, round(min(x[2]), 6) AS least, round(max(x[2]), 6) AS most FROM M GROUP BY ALL""")
def a28(spark, sf):
    return rounded(M.measurement_report(labels(spark, sf), "score", "confidence"), digits=6)


def measured_labels(spark, sf):
    """Labels with the fields of the measurement report."""
    i = F.col("label_id")
    pick = lambda *x: F.get(F.array(*(F.lit(v) for v in x)), (i % len(x)).cast("int"))
    return labels(spark, sf).withColumns({
        "component": pick("origin", "destination", "paired", "temporal"), "case": pick("quiet", "capture", "unspecified", "check", "other"), "category_source": pick(None, "fen"), "occupancy_before": pick("own", "", "unknown", "enemy", None),
        "occupancy_after": pick("own", "own", "empty"), "relative": F.when(i % 7 > 0, F.col("score") / 2 + i % 3)})


ML = L + """, ML AS (SELECT * REPLACE (['origin', 'destination', 'paired', 'temporal'][label_id % 4 + 1] AS component, ['quiet', 'capture', 'unspecified', 'check', 'other'][label_id % 5 + 1] AS "case"), [NULL, 'fen'][label_id % 2 + 1] AS category_source,
  ['own', '', 'unknown', 'enemy', NULL][label_id % 5 + 1] AS occupancy_before, ['own', 'own', 'empty'][label_id % 3 + 1] AS occupancy_after, CASE WHEN label_id % 7 > 0 THEN score / 2 + label_id % 3 END AS relative FROM L)"""


@query("a28_endpoint_metrics", f"""WITH {ML}, C AS (SELECT component, {COUNTS} FROM ML WHERE component <> 'temporal' GROUP BY component) SELECT *, {RATES} FROM C""")
def a28e(spark, sf):
    return rounded(M.endpoint_metrics(measured_labels(spark, sf)))


@query("a28_category_sources", f"""WITH {ML}, T AS (SELECT * FROM ML WHERE "case" <> 'unspecified') SELECT 'source' AS kind, coalesce(category_source, 'labeled_frame') AS name, count(*) AS n FROM T GROUP BY ALL
  UNION ALL SELECT 'category', name, count(T.label_id) FROM (VALUES ('capture'), ('check'), ('promotion'), ('quiet'), ('double_pawn')) v(name) LEFT JOIN T ON T."case" = name GROUP BY ALL""")
def a28c(spark, sf):
    return M.category_sources(measured_labels(spark, sf))


@query("a28_occupancy_counts", f"""WITH {ML}, U AS (SELECT 'occupancy_before' AS field, occupancy_before AS value FROM ML UNION ALL SELECT 'occupancy_after', occupancy_after FROM ML) SELECT field, value, count(*) AS n FROM U WHERE value IS NOT NULL AND value NOT IN ('', 'unknown') GROUP BY ALL""")
def a28o(spark, sf):
    return M.occupancy_counts(measured_labels(spark, sf), "occupancy_before", "occupancy_after")


def _method(name: str, column: str) -> str:
    return f"""(WITH R AS (SELECT truth, regime, {column} AS score FROM ML WHERE {column} IS NOT NULL), D AS (SELECT * FROM R WHERE truth <> 'uncertain'), O AS (SELECT DISTINCT score AS threshold FROM D), Z AS (SELECT regime, count(*) FILTER (truth = 'positive') AS pos, count(*) FILTER (truth = 'negative') AS neg FROM D GROUP BY regime),
  H AS (SELECT threshold, Z.regime, pos, neg, count(*) FILTER (truth = 'positive' AND score >= threshold) AS tp, count(*) FILTER (truth = 'negative' AND score >= threshold) AS fp FROM O CROSS JOIN Z JOIN D ON D.regime = Z.regime GROUP BY ALL),
  K AS (SELECT threshold, min(coalesce(tp / nullif(tp + fp, 0), 0)) FILTER (pos + neg >= 5) AS wp, min(coalesce(tp / nullif(pos, 0), 0)) FILTER (pos + neg >= 5) AS wr, max(coalesce(fp / nullif(neg, 0), 0)) FILTER (pos + neg >= 5) AS wf, count(*) FILTER (pos + neg >= 5) AS n, CAST(sum(tp) AS DOUBLE) / nullif(sum(pos), 0) AS r, sum(pos + neg) AS labeled FROM H GROUP BY threshold),
  B AS (SELECT *, coalesce(labeled >= 30 AND n > 0 AND wp >= 0.95 AND wr >= 0.95 AND wf <= 0.02, false) AS meets FROM K)
  SELECT '{name}' AS method, (SELECT count(*) FROM R) AS rows, threshold, round(wp, 9) AS worst_precision, round(wr, 9) AS worst_recall, round(wf, 9) AS worst_fpr, CASE WHEN meets THEN 'pass' WHEN n = 0 OR labeled < 30 THEN 'insufficient_data' ELSE 'advisory' END AS status
  FROM B ORDER BY meets DESC, coalesce(wr, -1) DESC, coalesce(wp, -1) DESC, coalesce(wf, 1), coalesce(nullif(r, 0), -1) DESC, threshold LIMIT 1)"""


@query("a28_method_comparison", f"WITH {ML} {_method('fixed', 'score')} UNION ALL {_method('board_relative', 'relative')}")
def a28m(spark, sf):
    return rounded(M.method_comparison(measured_labels(spark, sf), {"fixed": "score", "board_relative": "relative"}, (30, 0.95, 0.95, 0.02)))


@query("a27_settle_quality", f"""WITH {L}, P AS (SELECT *, "case" AS phase, score / 10 AS settle_delay, score < 5 AS premature FROM L),
  C AS (SELECT phase, {COUNTS}, avg(settle_delay) AS mean_delay, max(settle_delay) AS most_delay, count(*) FILTER (premature) AS premature_count FROM P GROUP BY phase)
  SELECT phase, tp, tn, fp, fn, uncertain, labeled, round(mean_delay, 9) AS mean_delay, round(most_delay, 9) AS most_delay, premature_count, {RATES} FROM C""")
def a27(spark, sf):
    return rounded(M.settle_quality(labels(spark, sf).withColumn("phase", F.col("case")).withColumn("settle_delay", F.col("score") / 10).withColumn("premature", F.col("score") < 5)))


@query("j18_metric_regression", f"""WITH {L}, C AS (SELECT detector, {COUNTS} FROM L WHERE "case" = 'long' GROUP BY detector), B AS (SELECT detector, {COUNTS} FROM L WHERE "case" = 'short' GROUP BY detector),
  X AS (SELECT coalesce(C.detector, B.detector) AS detector, C.tp / nullif(C.tp + C.fp, 0) - B.tp / nullif(B.tp + B.fp, 0) AS p, C.tp / nullif(C.tp + C.fn, 0) - B.tp / nullif(B.tp + B.fn, 0) AS r,
  C.fp / nullif(C.fp + C.tn, 0) - B.fp / nullif(B.fp + B.tn, 0) AS f FROM C FULL JOIN B ON B.detector = C.detector)
  SELECT detector, round(p, 9) AS precision_delta, round(r, 9) AS recall_delta, round(f, 9) AS fpr_delta, coalesce(p < -0.02 OR r < -0.02 OR f > 0.02, false) AS regression FROM X""")
def j18(spark, sf):
    rows = labels(spark, sf)
    return rounded(M.metric_regression(M.confusion_metrics(rows.filter("case = 'long'"), "detector"), M.confusion_metrics(rows.filter("case = 'short'"), "detector")))


@query("t3_representative_errors", f"""WITH {L}, K AS (SELECT 'confident_error' AS kind, label_id, confidence, regime, row_number() OVER (PARTITION BY regime ORDER BY confidence DESC, label_id) AS place FROM L WHERE truth <> 'uncertain' AND prediction <> 'uncertain' AND truth <> prediction
  UNION ALL SELECT 'uncertain_success', label_id, confidence, regime, row_number() OVER (PARTITION BY regime ORDER BY confidence, label_id) FROM L WHERE truth <> 'uncertain' AND truth = prediction)
  SELECT kind, CAST(place AS INT) AS place, label_id, round(confidence, 9) AS confidence, regime FROM K WHERE place <= 10""")
def t3(spark, sf):
    return rounded(M.representative_errors(labels(spark, sf), 10, "regime"))
