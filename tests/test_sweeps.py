"""Threshold sweeps and the robust operating point in ranges, against slow versions."""

import random

import pytest
from pyspark.sql import functions as F

from obsline.operators import metrics as M

KIND = "truth string, score double, regime string"


def slow_point(rows, target, least=M.MIN_REGIME):
    scored = [(t, x, r or "unspecified") for t, x, r in rows if t != "uncertain" and x is not None]
    best = None
    for threshold in {x for _, x, _ in scored}:
        regimes = {}
        for t, x, r in scored:
            regimes.setdefault(r, []).append((t == "positive", x >= threshold))
        found = []
        for own in regimes.values():
            tp, fp, pos = sum(t and p for t, p in own), sum(p and not t for t, p in own), sum(t for t, _ in own)
            if len(own) >= least:
                found.append((tp / (tp + fp) if tp + fp else 0.0, tp / pos if pos else 0.0, fp / (len(own) - pos) if len(own) > pos else 0.0))
        if not found:
            return None
        worst = min(f[0] for f in found), min(f[1] for f in found), max(f[2] for f in found)
        pos = sum(t == "positive" for t, _, _ in scored)
        recall = sum(t == "positive" and x >= threshold for t, x, _ in scored) / pos if pos else 0
        meets = len(scored) >= target[0] and worst[0] >= target[1] and worst[1] >= target[2] and worst[2] <= target[3]
        rank = (meets, worst[1], worst[0], -worst[2], recall or -1, -threshold)
        best = max(best or (rank,), (rank, threshold, worst, len(found)), key=lambda b: b[0])
    return best


@pytest.mark.parametrize("size", [100_000, 7])
def test_robust_operating_point_matches_a_slow_version(spark, monkeypatch, size):
    monkeypatch.setattr(M, "RANGE", size)
    rng = random.Random(3)
    rows = [(rng.choice(["positive", "negative", "uncertain"]), rng.choice([None, *[round(rng.random(), 2)] * 9]), rng.choice([None, *"abcdef"])) for _ in range(500)]
    rows += [("positive", 0.5, "tiny")] * 2 + [("positive", 0.97, "late")] * 6
    for target in ((30, 0.95, 0.95, 0.02), (30, 0.3, 0.4, 0.6)):
        got = M.robust_operating_point(spark.createDataFrame(rows, KIND), target).first()
        rank, threshold, worst, regimes = slow_point(rows, target)
        assert (got.threshold, got.worst_recall, got.worst_fpr, got.regime_count, got.meets_target) == (threshold, worst[1], worst[2], regimes, rank[0])
        assert abs(got.worst_precision - worst[0]) < 1e-12
    assert M.robust_operating_point(spark.createDataFrame([], KIND), target).collect() == []
    alone = M.robust_operating_point(spark.createDataFrame([("positive", 0.1, "x")], KIND), target).first()
    assert (alone.status, alone.regime_count, alone.worst_recall) == ("insufficient_data", 0, None)


def test_more_than_a_thousand_regimes(spark):
    rows = [("positive" if i % 3 else "negative", (i * 7919 % 1000) / 1000, f"r{i % 1500}") for i in range(9000)]
    got = M.robust_operating_point(spark.createDataFrame(rows, KIND), (30, 0.95, 0.95, 0.02)).first()
    assert got.regime_count == 1500 and got.labeled == 9000


def test_worst_of_steps_below_and_above_blocks(spark, monkeypatch):
    rng = random.Random(5)
    places = 200_000
    steps = []
    for _ in range(40):
        a, b = sorted(rng.sample(range(places + 1), 2))
        steps.append((a, b, rng.random(), rng.random(), rng.random()))
    steps.append((0, places, 2.0, 2.0, -1.0))
    got = {r.place: (r.precision, r.recall, r.fpr) for r in M._worst(spark.createDataFrame(steps, "first long, end long, precision double, recall double, fpr double"), places)
           .filter(F.col("place") % 997 == 0).collect()}
    assert len(got) == 201
    for place, found in got.items():
        own = [s for s in steps if s[0] <= place < s[1]]
        assert found == (min(s[2] for s in own), min(s[3] for s in own), max(s[4] for s in own))


def test_ranges_are_bounded_for_scores_between_zero_and_one(spark):
    scores = spark.range(300_000).select((F.rand(1) ** 8).alias("score"), F.lit(1).alias("p"), F.lit(0).alias("q")).union(
        spark.range(5).select((F.col("id") * 1e30).alias("score"), F.lit(0), F.lit(1)))
    M_RANGE, M.RANGE = M.RANGE, 20_000
    try:
        sizes = [r["count"] for r in M._ranges(scores).groupBy("range").count().collect()]
    finally:
        M.RANGE = M_RANGE
    assert sum(sizes) == 300_005 and max(sizes) <= 30_000
