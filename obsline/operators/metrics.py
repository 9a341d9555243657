"""Calibration metrics A1-A18, A27, A28, J18, T3: grouped aggregates over label rows.

Label rows hold truth and prediction as positive, negative or uncertain (normalize_label), a confidence,
a score, and dimensions. Undefined rates are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsline.operators.scan import SEGMENT, segments

# Acceptance targets by detector (least labelled, precision, recall; most false positive rate).
TARGETS = [
    ("yellow", 30, 0.95, 0.95, 0.02), ("clock", 30, 0.98, 0.95, 0.02),
    ("hover", 30, 0.95, 0.95, 0.03), ("geometry", 30, 0.98, 0.98, 0.01),
]
STRESS_CONDITIONS = ("font_size", "anti_aliasing", "compression", "brightness", "low_time_formatting", "separators", "partial_changes")
TOLERANCE = 0.02
MIN_REGIME = 5
#: Scores to a range of a sweep.
RANGE = 100_000


def rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def counts(truth: Column, prediction: Column) -> list[Column]:
    def n(t: str, p: str, name: str) -> Column:
        return F.count_if((truth == t) & (prediction == p)).alias(name)

    unsure = (truth == "uncertain") | (prediction == "uncertain")
    return [n("positive", "positive", "tp"), n("negative", "negative", "tn"), n("negative", "positive", "fp"), n("positive", "negative", "fn"),
            F.count_if(unsure).alias("uncertain"), F.count_if(~unsure).alias("labeled")]


def with_rates(df: DataFrame) -> DataFrame:
    c = F.col
    return (df.withColumn("precision", rate(c("tp"), c("tp") + c("fp"))).withColumn("recall", rate(c("tp"), c("tp") + c("fn")))
            .withColumn("fpr", rate(c("fp"), c("fp") + c("tn"))).withColumn("fnr", rate(c("fn"), c("fn") + c("tp")))
            .withColumn("accuracy", rate(c("tp") + c("tn"), c("labeled"))))


def confusion_metrics(labels: DataFrame, *by: str) -> DataFrame:
    """A1: counts and rates, overall or by dimensions."""
    return with_rates(labels.groupBy(*by).agg(*counts(F.col("truth"), F.col("prediction"))))


def confidence_bins(labels: DataFrame, bins: int = 10) -> DataFrame:
    """A2: [lower, upper) bins of confidence, the last one closed; empty bins stay."""
    sure = labels.filter("truth <> 'uncertain' AND prediction <> 'uncertain' AND confidence BETWEEN 0 AND 1")
    found = sure.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("observed_accuracy"))
    every = labels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "observed_accuracy")


def metrics_by_dimension(labels: DataFrame, conditions: str = "conditions") -> DataFrame:
    """A3: metrics by detector, and within it by regime, component and case (one pass of grouping sets).

    Conditions are exploded, which multiplies rows, so that dimension is aggregated apart.
    """
    dims = ["regime", "component", "case"]
    sets = labels.groupingSets([["detector"]] + [["detector", d] for d in dims], "detector", *dims).agg(
        F.grouping_id().alias("gid"), *counts(F.col("truth"), F.col("prediction")))
    name = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "regime").when(F.col("gid") == 5, "component").otherwise("case")
    tall = sets.select("detector", name.alias("dimension"), F.coalesce("regime", "component", "case", F.lit("all")).alias("value"),
                       "tp", "tn", "fp", "fn", "uncertain", "labeled")
    by_condition = labels.select("detector", "truth", "prediction", F.explode(conditions).alias("value")).groupBy("detector", "value").agg(
        *counts(F.col("truth"), F.col("prediction"))).select("detector", F.lit("condition").alias("dimension"), "value", "tp", "tn", "fp", "fn", "uncertain", "labeled")
    return with_rates(tall.unionByName(by_condition))


def collapse_transitions(labels: DataFrame) -> DataFrame:
    """A4: frame labels to transition labels; what disagrees is uncertain."""
    def one(c: str) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c)).otherwise("uncertain").alias(c)

    sound = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return labels.filter("transition_id IS NOT NULL AND transition_id <> ''").groupBy("transition_id").agg(
        one("truth"), one("prediction"), F.avg(sound).alias("confidence"))


def reading_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """A5: digits and complete strings right, from (expected, selected, measured)."""
    e, s = (F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "") for c in ("expected", "selected"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(e), F.length(s)), F.lit(1))), F.lit(0),
                       lambda a, i: a + F.when((F.length(e) > 0) & (F.length(s) > 0) & (e.substr(i, F.lit(1)) == s.substr(i, F.lit(1))), 1).otherwise(0))
    used = F.col("measured")
    found = rows.withColumn("same", same).withColumn("most", F.greatest(F.length(e), F.length(s))).groupBy(*by).agg(
        F.count_if(used).alias("rows"), F.count_if(~used).alias("unmeasured_rows"),
        F.coalesce(F.sum(F.when(used, F.col("same"))), F.lit(0)).alias("digit_correct"),
        F.coalesce(F.sum(F.when(used, F.col("most"))), F.lit(0)).alias("digit_total"),
        F.count_if(used & (F.coalesce("expected", F.lit("")) == F.coalesce("selected", F.lit("")))).alias("complete_correct"),
        F.count_if(used & (F.coalesce("selected", F.lit("")) != "")).alias("rows_with_reading"))
    return found.withColumn("digit_accuracy", rate(F.col("digit_correct"), F.col("digit_total"))).withColumn(
        "complete_accuracy", rate(F.col("complete_correct"), F.col("rows")))


def perturbation_summary(rows: DataFrame, variant: str = "variant", baseline: str = "native", drop: float = TOLERANCE) -> DataFrame:
    """A5 by variant against the baseline variant, with a status."""
    found = reading_accuracy(rows, variant)
    base = found.filter(F.col(variant) == baseline).select(F.col("complete_accuracy").alias("baseline_accuracy"))
    joined = found.join(F.broadcast(base), how="left")  # one row at most
    status = F.when(F.col("rows") == 0, "unmeasured").when(F.col("baseline_accuracy").isNull(), "no_baseline").when(
        F.col("complete_accuracy") < F.col("baseline_accuracy") - drop, "degraded").otherwise("stable")
    return joined.withColumn("status", status)


def usable_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group with all three components; usable when all of them are right."""
    parts = rows.groupBy(*keys).pivot("component", ["active_side", "white_ocr", "black_ocr"]).agg(
        F.first(F.struct("truth", "prediction", "expected", "selected", "measured")))
    whole = parts.filter("active_side IS NOT NULL AND white_ocr IS NOT NULL AND black_ocr IS NOT NULL AND white_ocr.measured AND black_ocr.measured")
    truths = F.array("active_side.truth", "white_ocr.truth", "black_ocr.truth")
    truth = F.when(F.forall(truths, lambda t: t == "positive"), "positive").when(
        F.forall(truths, lambda t: t.isin("positive", "negative")), "negative").otherwise("uncertain")
    right = (F.col("active_side.prediction") == "positive") & F.col("white_ocr.selected").eqNullSafe(F.col("white_ocr.expected")) & F.col(
        "black_ocr.selected").eqNullSafe(F.col("black_ocr.expected"))
    return whole.select(*keys, truth.alias("truth"), F.when(right, "positive").otherwise("negative").alias("prediction"))


def candidate_outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, expected, observed) rows by outcome; null means that a field is not there."""
    e, o = F.trim("expected"), F.trim("observed")
    outcome = (F.when(o.isNull(), "unmeasured").when((e != "") & (o == ""), "missing_candidate").when((e != "") & (o == e), "exact")
               .when(e != "", "wrong_candidate").when(o != "", "unexpected_candidate").when(e.isNotNull(), "no_candidate").otherwise("unmeasured"))
    kept = rows.filter("expected IS NOT NULL OR observed IS NOT NULL").dropDuplicates([*keys, "expected", "observed"])
    return kept.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def numeric_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """A9."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def decision_counts(df: DataFrame, decision: str) -> DataFrame:
    """A10."""
    return df.filter(F.col(decision).isNotNull() & (F.col(decision) != "")).groupBy(decision).agg(F.count("*").alias("n"))


def _ranges(at: DataFrame) -> DataFrame:
    """The rows with ``range``, a number that rises with the score: some RANGE rows each, whatever the scores are like."""
    return segments(at, "score", RANGE).withColumnRenamed(SEGMENT, "range")


def _running(at: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums tp and fp of p and q from the greatest score down, with the sums pos and neg, the place of
    each score (from 0) among the ``scores`` of its key, for each key.

    A row is a score of a key. Sums are taken within ranges of scores and added to those of the ranges above, so no task holds
    all the scores of a key.
    """
    ranged = _ranges(at)
    sums = ranged.groupBy(*keys, "range").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count("*").alias("k"))
    above = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    base = sums.select(*keys, "range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(n) for c, n in (("p", "tp0"), ("q", "fp0"), ("k", "k0"))],
                       F.sum("p").over(everything).alias("pos"), F.sum("q").over(everything).alias("neg"), F.sum("k").over(everything).alias("scores"))
    down = Window.partitionBy(*keys, "range").orderBy(F.desc("score"))
    return ranged.join(base, [*keys, "range"]).select(
        *keys, "score", (F.col("tp0") + F.sum("p").over(down)).alias("tp"), (F.col("fp0") + F.sum("q").over(down)).alias("fp"), "pos", "neg",
        (F.col("k0") + F.row_number().over(down) - 1).alias("place"), "scores")


def _by_score(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by, "score").agg(F.count_if(F.col("truth") == "positive").alias("p"), F.count_if(F.col("truth") == "negative").alias("q"))


def threshold_sweep(labels: DataFrame, *by: str) -> DataFrame:
    """Metrics at every distinct score as threshold, by a running sum over distinct scores.

    Rows are counted by score first, so windows see distinct scores only, in bounded ranges.
    """
    scored = labels.filter("score IS NOT NULL AND truth <> 'uncertain'")
    run = _running(_by_score(scored, *by), list(by))
    full = run.select(*by, F.col("score").alias("threshold"), "tp", (F.col("neg") - F.col("fp")).alias("tn"), "fp",
                      (F.col("pos") - F.col("tp")).alias("fn"), (F.col("pos") + F.col("neg")).alias("labeled"))
    return with_rates(full)


def _covering(first: str, end: str, levels: int) -> Column:
    """The nodes of a binary tree over places that make up [first, end): an array of (level, node), two a level at most."""
    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        low, high = F.ceil(F.col(first) / size).cast("long"), F.floor(F.col(end) / size).cast("long")
        lower = F.when((low < high) & (low % 2 == 1), F.struct(k.alias("level"), low.alias("node")))
        upper = F.when((low < high) & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("node")))
        return F.array(lower, upper)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
    return F.filter(every, lambda x: x.isNotNull())


def _worst(steps: DataFrame, places: int) -> DataFrame:
    """(place, precision, recall, fpr): the least precision and recall and the greatest rate of false positives at each place.

    ``steps`` is (first, end, precision, recall, fpr): values that hold on [first, end). Each is given to the nodes of a binary tree
    that make up its places, and a place takes the worst of the nodes above it. Nodes with more than 2 ** low places below them
    are looked up by blocks of so many places, 65,536 at most, so that no node meets more than those rows.
    """
    levels = max(places - 1, 1).bit_length()
    low = max(0, levels - 16)
    worst = [F.min("precision").alias("precision"), F.min("recall").alias("recall"), F.max("fpr").alias("fpr")]
    nodes = steps.withColumn("at", F.explode(_covering("first", "end", levels))).groupBy("at.level", "at.node").agg(*worst)
    spark = steps.sparkSession

    def looked_up(rows: DataFrame, name: str, levels_: Column, shift: int) -> DataFrame:
        size = F.pow(F.lit(2.0), F.col("level") - shift).cast("long")
        above = rows.withColumn("level", F.explode(levels_)).withColumn("node", F.floor(F.col(name) / size).cast("long"))
        return above.join(nodes, ["level", "node"]).groupBy(name).agg(*worst)

    blocks = looked_up(spark.range(-(-places // (1 << low))).withColumnRenamed("id", "block"), "block", F.sequence(F.lit(low), F.lit(levels)), low)
    if not low:
        return blocks.withColumnRenamed("block", "place")
    all_places = spark.range(places).withColumnRenamed("id", "place")
    parts = looked_up(all_places, "place", F.sequence(F.lit(0), F.lit(low - 1)), 0).unionByName(
        all_places.withColumn("block", F.floor(F.col("place") / (1 << low)).cast("long")).join(blocks, "block").drop("block"))
    return parts.groupBy("place").agg(*worst)


def robust_operating_point(labels: DataFrame, target: tuple[int, float, float, float], min_regime: int = MIN_REGIME) -> DataFrame:
    """Thresholds ranked by their worst supported regime; the best comes first, with its status.

    The curve of a regime is a step function: from one of its own scores down to the next it has one value, and above
    the first it counts no rows. Thresholds are numbered, each step is an interval of numbers, and the worst of the steps over each
    threshold comes from a tree of intervals; thresholds never meet regimes. There may be any number of regimes.
    """
    least, precision, recall, fpr = target
    scored = labels.filter("score IS NOT NULL AND truth <> 'uncertain'").withColumn("regime", F.coalesce("regime", F.lit("unspecified")))
    overall = _running(_by_score(scored), [])
    places = overall.agg(F.max("scores")).first()[0] or 0
    own = _running(_by_score(scored, "regime"), ["regime"]).filter(F.col("pos") + F.col("neg") >= min_regime)
    tp, fp = F.col("tp"), F.col("fp")
    curve = own.join(overall.select("score", F.col("place").alias("first")), "score").select(
        "regime", "place", "first", F.coalesce(rate(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(rate(tp, F.col("pos")), F.lit(0.0)).alias("recall"),
        F.coalesce(rate(fp, F.col("neg")), F.lit(0.0)).alias("fpr"))
    after = curve.select("regime", (F.col("place") - 1).alias("place"), F.col("first").alias("end"))
    ends = curve.join(after, ["regime", "place"], "left").withColumn("end", F.coalesce("end", F.lit(places)))
    starts = curve.filter("place = 0 AND first > 0").select(F.lit(0).cast("long").alias("first"), F.col("first").alias("end"), *[F.lit(0.0).alias(c) for c in ("precision", "recall", "fpr")])
    steps = ends.select("first", "end", "precision", "recall", "fpr").unionByName(starts)
    regimes = curve.filter("place = 0").count()
    per = _worst(steps, places).select("place", *[F.col(c).alias(f"worst_{c}") for c in ("precision", "recall", "fpr")])
    joined = overall.join(per, "place", "left").select(
        F.col("score").alias("threshold"), "worst_precision", "worst_recall", "worst_fpr", F.lit(regimes).cast("long").alias("regime_count"),
        (F.col("pos") + F.col("neg")).alias("labeled"), rate(tp, F.col("pos")).alias("recall"))
    meets = F.coalesce((F.col("labeled") >= least) & (F.col("regime_count") > 0) & (F.col("worst_precision") >= precision)
                       & (F.col("worst_recall") >= recall) & (F.col("worst_fpr") <= fpr), F.lit(False))
    order = [F.desc("meets_target"), F.desc(F.coalesce("worst_recall", F.lit(-1.0))), F.desc(F.coalesce("worst_precision", F.lit(-1.0))),
             F.asc(F.coalesce("worst_fpr", F.lit(1.0))), F.desc(F.coalesce(F.nullif(F.col("recall"), F.lit(0.0)), F.lit(-1.0))), F.asc("threshold")]
    status = F.when(F.col("meets_target"), "pass").when((F.col("regime_count") == 0) | (F.col("labeled") < least), "insufficient_data").otherwise("advisory")
    return joined.withColumn("meets_target", meets).orderBy(*order).limit(1).select(
        "threshold", "worst_precision", "worst_recall", "worst_fpr", "regime_count", "labeled", "recall", "meets_target", status.alias("status"))


def threshold_grid(rows: DataFrame, ends: list[float], pairs: list[float]) -> DataFrame:
    """Metrics of the endpoint and pair thresholds, each of the grid, from (truth, origin, target).

    Rows are counted by the cell that they pass (least end, sum), so the grid meets cells, not rows.
    """
    last_end = F.size(F.filter(F.array(*map(F.lit, ends)), lambda t: t <= F.least("origin", "target")))
    last_pair = F.size(F.filter(F.array(*map(F.lit, pairs)), lambda t: t <= F.col("origin") + F.col("target")))
    cells = rows.filter("truth <> 'uncertain'").groupBy(last_end.alias("e"), last_pair.alias("p")).agg(
        F.count_if(F.col("truth") == "positive").alias("pos"), F.count_if(F.col("truth") == "negative").alias("neg"))
    every = F.array(*(F.struct(F.lit(i + 1).alias("ei"), F.lit(j + 1).alias("pi"), F.lit(float(e)).alias("endpoint"), F.lit(float(p)).alias("pair"))
                      for i, e in enumerate(ends) for j, p in enumerate(pairs)))
    hit = (F.col("e") >= F.col("ei")) & (F.col("p") >= F.col("pi"))
    found = cells.select("*", F.inline(every)).groupBy("endpoint", "pair").agg(  # at most grid x grid rows
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.lit(0)).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(hit, F.lit(0)).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.col("pos") + F.col("neg")).alias("labeled"))
    return with_rates(found)


def evaluate_target(metrics: DataFrame, targets: list[tuple[str, int, float, float, float]] = TARGETS) -> DataFrame:
    """insufficient_data, pass or fail by detector; detectors without a target have none."""
    table = metrics.sparkSession.createDataFrame(targets, "detector string, least_labeled int, least_precision double, least_recall double, most_fpr double")
    ok = ((F.coalesce("precision", F.lit(-1.0)) >= F.col("least_precision")) & (F.coalesce("recall", F.lit(-1.0)) >= F.col("least_recall"))
          & (F.coalesce("fpr", F.lit(2.0)) <= F.col("most_fpr")))
    return metrics.join(F.broadcast(table), "detector", "left").withColumn(
        "status", F.when(F.col("least_labeled").isNull(), "no_target").when(F.col("labeled") < F.col("least_labeled"), "insufficient_data").when(
            ok, "pass").otherwise("fail"))


def coverage(df: DataFrame, value: str, required: tuple[str, ...] = STRESS_CONDITIONS, *by: str) -> DataFrame:
    """Required values that were seen and those that are missing."""
    need = F.array(*map(F.lit, required))
    seen = F.sort_array(F.collect_set(F.when(F.col(value).isin(*required), F.col(value))))
    found = df.groupBy(*by).agg(seen.alias("observed"))
    return found.withColumn("missing", F.array_except(need, "observed")).withColumn(
        "status", F.when(F.size("missing") == 0, "complete").otherwise("incomplete"))


def metric_regression(candidate: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Differences of two metric tables by detector, and whether one is a regression."""
    names = ["precision", "recall", "fpr"]
    c = candidate.select("detector", *(F.col(n).alias(f"c_{n}") for n in names))
    b = baseline.select("detector", *(F.col(n).alias(f"b_{n}") for n in names))
    joined = c.join(b, "detector", "full_outer")
    for n in names:
        joined = joined.withColumn(f"{n}_delta", F.col(f"c_{n}") - F.col(f"b_{n}"))
    worse = (F.col("precision_delta") < -tolerance) | (F.col("recall_delta") < -tolerance) | (F.col("fpr_delta") > tolerance)
    return joined.select("detector", *(f"{n}_delta" for n in names), F.coalesce(worse, F.lit(False)).alias("regression"))


def representative_errors(labels: DataFrame, k: int = 10, *by: str) -> DataFrame:
    """The wrong labels of greatest confidence and the right ones of least, k of each."""
    keys = [F.col(b) for b in by]
    wrong = labels.filter("truth <> 'uncertain' AND prediction <> 'uncertain' AND truth <> prediction AND confidence IS NOT NULL")
    right = labels.filter("truth <> 'uncertain' AND truth = prediction AND confidence IS NOT NULL")

    def first(df: DataFrame, kind: str, order: Column) -> DataFrame:
        if not by:
            ranked = df.orderBy(order, "label_id").limit(k)
            at = Window.orderBy(order, "label_id")
        else:
            ranked, at = df, Window.partitionBy(*keys).orderBy(order, "label_id")
        return ranked.withColumn("place", F.row_number().over(at)).filter(F.col("place") <= k).select(F.lit(kind).alias("kind"), "place", "label_id", "confidence", *by)

    return first(wrong, "confident_error", F.desc("confidence")).unionByName(first(right, "uncertain_success", F.asc("confidence")))


def settle_quality(labels: DataFrame) -> DataFrame:
    """Metrics of settled against mid-motion labels, with delays and premature settles."""
    found = labels.groupBy("phase").agg(*counts(F.col("truth"), F.col("prediction")), F.avg("settle_delay").alias("mean_delay"),
                                        F.max("settle_delay").alias("most_delay"), F.count_if("premature").alias("premature_count"))
    return with_rates(found)


def measurement_report(labels: DataFrame, *measures: str, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, median and spread of each measure by regime, in long form.

    The median is an element whose rank is off by at most one in ``accuracy``, so no group is held in memory.
    """
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
    tall = labels.select(F.coalesce("regime", F.lit("unspecified")).alias("regime"), F.explode(pairs).alias("x")).select("regime", "x.*").filter("value IS NOT NULL")
    return tall.groupBy("regime", "measure").agg(F.count("*").alias("n"), F.avg("value").alias("mean"),
                                                 F.percentile_approx("value", 0.5, accuracy).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


# Components and categories of the measurement report.
COMPONENTS = ("origin", "destination", "paired")
CATEGORIES = ("capture", "check", "promotion", "quiet", "double_pawn")
UNKNOWN = ("", "unknown")


def endpoint_metrics(labels: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Metrics of each component, zero counts for one without labels, with its target's status (``detector`` as labelled)."""
    every = labels.sparkSession.createDataFrame([(c,) for c in components], "component string")
    found = confusion_metrics(labels.filter(F.col("component").isin(*components)), "component")
    return with_rates(every.join(found.select("component", "tp", "tn", "fp", "fn", "uncertain", "labeled"), "component", "left").na.fill(0))


def category_sources(labels: DataFrame, required: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(kind, name, n): where categorised labels come from, and which required categories were seen (n rows, 0 for a missing one)."""
    told = labels.filter(F.coalesce("case", F.lit("unspecified")) != "unspecified")
    sources = told.groupBy(F.coalesce("category_source", F.lit("labeled_frame")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("source").alias("kind"), "name", "n")
    every = labels.sparkSession.createDataFrame([(c,) for c in required], "name string")
    seen = told.groupBy(F.col("case").alias("name")).agg(F.count("*").alias("n"))
    return sources.unionByName(every.join(seen, "name", "left").select(F.lit("category").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n")))


def occupancy_counts(labels: DataFrame, *fields: str) -> DataFrame:
    """(field, value, n) of each field's known values."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    tall = labels.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("value").isNotNull() & ~F.col("value").isin(*UNKNOWN))
    return tall.groupBy("field", "value").agg(F.count("*").alias("n"))


def method_comparison(labels: DataFrame, methods: dict[str, str], target: tuple[int, float, float, float]) -> DataFrame:
    """For each method (name to score column) the labels that it measures and its robust operating point."""
    out = None
    for name, column in methods.items():
        measured = labels.withColumn("score", F.col(column).cast("double")).filter("score IS NOT NULL")
        rows = measured.agg(F.count("*").alias("rows")).withColumn("one", F.lit(1))  # one row, and one at most to meet it
        found = rows.join(robust_operating_point(measured, target).withColumn("one", F.lit(1)), "one", "left").select(
            F.lit(name).alias("method"), "rows", "threshold", "worst_precision", "worst_recall", "worst_fpr", F.coalesce("status", F.lit("insufficient_data")).alias("status"))
        out = found if out is None else out.unionByName(found)
    return out
