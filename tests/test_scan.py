"""Scans in segments against windows over whole streams; the overlap of branches against a table of prefixes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from obsline.operators import branches as B
from obsline.operators import evidence as X
from obsline.operators import scan as N
from obsline.operators import windows as W

KIND = "stream_id long, ts timestamp, observation_id long, v long"


def made(n=400):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.02 else base + timedelta(seconds=rng.choice([rng.randint(0, 50), rng.randint(0, 100_000)]))
        rows.append((rng.choice([1, 1, 1, 1, 2, None]), at, i, rng.choice([None, None, rng.randint(-9, 9)])))
    return rows


@pytest.mark.parametrize("descending", [False, True])
def test_scans_match_whole_windows(spark, descending):
    df = spark.createDataFrame(made(), KIND).repartition(5)
    way = F.desc if descending else F.asc
    w = Window.partitionBy("stream_id").orderBy(way("ts"), way("observation_id"))
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("observation_id", F.lag("v").over(w).alias("a"), F.last("v", ignorenulls=True).over(up_to).alias("b"), F.sum("v").over(up_to).alias("c"), F.min("v").over(before).alias("d"))
    for rows in (10, 100_000):
        found = N.scan(df, "stream_id", ("ts", "observation_id"), {"a": F.col("v")}, {"b": F.col("v")}, {"c": F.col("v")}, {"d": F.col("v")}, descending, rows)
        assert sorted(found.select("observation_id", "a", "b", "c", "d").collect()) == sorted(want.collect())
    assert found.limit(0).collect() == [] and N.scan(df.limit(0), "stream_id", ("ts", "observation_id"), last={"b": F.col("v")}).collect() == []


def test_segments_are_bounded(spark):
    df = spark.range(50_000).select(F.lit(1).alias("stream_id"), (F.rand(4) ** 6).alias("ts"))
    sizes = [r["count"] for r in N.segments(df, "ts", 4_000).groupBy(N.SEGMENT).count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 6_000 and len(sizes) >= 10


def test_operators_in_segments(spark, monkeypatch):
    df = spark.createDataFrame(made(300), KIND).filter("ts IS NOT NULL").withColumn("target_seq", F.when(F.col("observation_id") % 17 == 0, F.col("v") + 100)).withColumn("seq", F.col("observation_id"))

    def results():
        return [sorted(map(str, d.collect())) for d in (
            W.coalesce_bursts(df, 500), W.carry_forward(df, "v").select("observation_id", "carried", "provenance"), W.monotonic_check(df, "v").select("observation_id", "previous"), X.latest_rollback(df).select("seq"))]

    whole = results()
    monkeypatch.setattr(N, "ROWS", 9)
    assert results() == whole and all(whole)


def slow_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_overlap_by_bits():
    rng = random.Random(7)
    for n in (0, 1, 5, 63, 64, 65, 200):
        for m in (0, 1, 60, 130):
            a, b = ([rng.choice("abcd") for _ in range(k)] for k in (n, m))
            assert B._common(a, b) == slow_common(a, b)


def test_branches_meet_blocks_of_the_main_line(spark):
    rng = random.Random(2)
    main = [(s, i, rng.choice("abcd")) for s in (1, 2) for i in range(300)]
    steps, want = [], {}
    for s in (1, 2):
        for k, (parent, n) in enumerate([(0, 5), (60, 10), (63, 1), (100, 130), (290, 30), (400, 3)]):
            own = [rng.choice("abcd") for _ in range(n)]
            steps += [(s, k, parent, i, m) for i, m in enumerate(own)]
            want[s, k] = (n, slow_common(own, [m for t, i, m in main if t == s and parent <= i < parent + n + 8]))
    got = B.lcs_replay_test(spark.createDataFrame(steps, "stream_id long, branch_id long, parent_seq long, step int, move string"), spark.createDataFrame(main, "stream_id long, seq long, move string"))
    assert {(r.stream_id, r.branch_id): (r.steps, r.matches) for r in got.collect()} == want
