"""Small hand-made cases: nulls, ties, empty inputs, order and partition independence, stream equals batch."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsline.functions import rules, scalars
from obsline.operators import branches as B
from obsline.operators import evidence as X
from obsline.operators import joins as J
from obsline.operators import measure as P
from obsline.operators import metrics as M
from obsline.operators import verify as C
from obsline.operators import windows as W
from obsline.sources import tables as S
from obsline.streaming import machines
from obsline.streaming import run as R

T0 = dt.datetime(2024, 1, 1)


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


# ---- scalars and rules

@pytest.mark.parametrize(("text", "want"), [("1:02:03", 3723), ("2:03", 123), ("2.03", 123), ("7", None), ("a:b", None), (None, None), ("", None)])
def test_reading_seconds(spark, text, want):
    assert values(one(spark, c=text), scalars.reading_seconds(F.col("c"))) == [want]


@pytest.mark.parametrize(("text", "want"), [("1::02:03", "1:02:03"), ("75:03", "1:15:03"), ("9", "0:00:09"), (":1:02:", "0:01:02"), ("0:61", None), ("9.5", "0:00:09.5"), ("", None), (None, None), ("1:2:3:4", None)])
def test_normal_reading(spark, text, want):
    assert values(one(spark, c=text), scalars.normal_reading(F.col("c"))) == [want]


@pytest.mark.parametrize(("text", "want"), [("", "0:00:00"), ("9", "0:00:09"), ("45", "0:00:45"), ("9.5", "0:00:09.5"), ("9:58", "0:09:58"), ("10:00", "0:10:00"), ("1:10:00", "1:10:00")])
def test_pad_reading(spark, text, want):
    assert values(one(spark, c=text), scalars.pad_reading(F.col("c"))) == [want]


@pytest.mark.parametrize(("options", "now", "before", "want"), [
    (["1:00", "1:30"], "1:05", "1:04", "1:05"), (["1:08", "1:30"], "1:05", "1:04", "1:08"), (["0:50", "0:40"], "9:99x", "1:00", "0:50"),
    (["9:00", "5:10"], "8:8:8", "5:12", "5:10"), ([], "1:00", "2:00", "1:00"), (["1:00"], "5:00", None, "5:00")])
def test_choose_reading(spark, options, now, before, want):
    df = spark.createDataFrame([(options, now, before)], "o array<string>, n string, b string")
    assert values(df, scalars.choose_reading(F.col("o"), F.col("n"), F.col("b"))) == [want]


def test_state_scalars(spark):
    df = one(spark, s="r3k2r/pp6/8/8/8/8/PP6/R3K2R b KQkq - 0 12")
    row = df.select(scalars.state_key(F.col("s")), scalars.side_to_move(F.col("s")), scalars.full_move(F.col("s")), scalars.seq_of_state(F.col("s")), F.size(scalars.expand_cells(F.col("s"))),
                    scalars.occupied_cells(F.col("s")), scalars.material(F.col("s")), scalars.move_number(F.col("s"))).first()
    assert tuple(row) == ("r3k2r/pp6/8/8/8/8/PP6/R3K2R b KQkq -", "b", 12, 23, 64, 10, 0, "12...")
    assert values(one(spark, c="1:13:07"), scalars.recover_suffix(F.col("c"))) == ["3:07"]
    assert values(spark.range(1), scalars.cue_time(F.lit(3661.5))) == ["01:01:01,500"]
    assert values(spark.range(1), scalars.evaluation_text(F.lit(35), F.lit(None).cast("int"), F.lit(False))) == ["+0.35"]
    assert values(spark.range(1), scalars.evaluation_text(F.lit(0), F.lit(-3), F.lit(True))) == ["+M3"]
    assert values(spark.range(1), scalars.unpack_id(scalars.pack_id(F.lit(5), F.lit(77)))["index"]) == [77]
    assert values(one(spark, c="a=1;ts=9;b=2"), F.map_keys(scalars.metadata_map(F.col("c"), ("ts",)))) == [["a", "b"]]
    assert values(one(spark, c='["a", " b"]'), scalars.condition_list(F.col("c"))) == [["a", "b"]] and values(one(spark, c=" a,b "), scalars.condition_list(F.col("c"))) == [["a", "b"]]
    assert values(spark.range(1), scalars.uncertainty(F.lit(-1.0))) == [1.0] and values(spark.range(1), scalars.distance_max(F.array(F.lit(1.0)), F.array(F.lit(3.0), F.lit(1.0)))) == [None]
    assert values(spark.range(1), scalars.line_style(F.lit(1), F.lit(180))["thickness"]) == [7]


@pytest.mark.parametrize(("event", "want"), [("ACCEPT", ("reducer", "accepted", "move_accepted")), ("CLOCK_X", ("clock", "observed", "clock_observation")), ("HISTORICAL_HANDOFF", ("revert", "observed", "revert_search")),
                                             ("HANDOFF_RESULT", ("revert", "recovered", "revert_applied")), ("HANDOFF_X", ("reducer", "observed", "state_handoff")), ("odd", ("reducer", "informational", "legacy_event"))])
def test_classify_event(spark, event, want):
    assert tuple(values(one(spark, e=event), rules.classify_event(F.col("e")))[0]) == want
    assert values(one(spark, e=None), rules.classify_event(F.col("e"))) == [None]


def test_labels_and_outcomes(spark):
    df = spark.createDataFrame([(" Yes ",), ("0",), (None,), ("maybe",)], "v string")
    assert values(df, rules.normalize_label(F.col("v"))) == ["positive", "negative", "uncertain", "uncertain"]
    df = spark.createDataFrame([("Rejected", "ACCEPT"), (None, "REBASE_X"), ("odd", "QUIET"), ("", "")], "o string, e string")
    assert values(df, rules.normalize_outcome(F.col("o"), F.col("e"))) == ["REJECT", "RECOVERING", "INFORMATIONAL", "INFORMATIONAL"]


# ---- metrics

LABELS = "label_id long, detector string, truth string, prediction string, confidence double, score double, regime string"


def test_undefined_rates_are_null(spark):
    df = spark.createDataFrame([(1, "hover", "negative", "negative", 1.0, None, None), (2, "hover", "uncertain", "positive", None, None, None)], LABELS)
    row = M.confusion_metrics(df, "detector").first()
    assert (row.tn, row.labeled, row.uncertain, row.precision, row.recall, row.accuracy) == (1, 1, 1, None, None, 1.0)
    assert [r.n for r in M.confidence_bins(df).orderBy("bin").collect()] == [0] * 9 + [1]
    assert M.evaluate_target(M.confusion_metrics(df, "detector")).first().status == "insufficient_data"
    empty = df.limit(0)
    assert M.confusion_metrics(empty, "detector").collect() == [] and M.threshold_sweep(empty).collect() == [] and M.confusion_metrics(empty).first().labeled == 0
    assert M.robust_operating_point(empty, (30, 0.9, 0.9, 0.1)).collect() == []


def test_threshold_choice_by_worst_regime(spark):
    rows = [(i, "d", "positive" if i % 2 else "negative", "negative", None, (10.0 if i % 2 else 1.0) + (5 if r == "b" else 0), r) for r in "ab" for i in range(10)]
    best = M.robust_operating_point(spark.createDataFrame(rows, LABELS), (10, 0.9, 0.9, 0.1)).first()
    assert (best.threshold, best.status, best.regime_count) == (10.0, "pass", 2)


def test_sweep_in_ranges_equals_one_window(spark):
    rng = random.Random(2)
    rows = [(i, "d", rng.choice(["positive", "negative"]), "negative", None, rng.choice([-5.5, -1.0, 0.0, 0.3, 2.0, 100.0, 5000.0]), "x") for i in range(400)]
    df = spark.createDataFrame(rows, LABELS)
    a, b = (sorted((r.threshold, r.tp, r.tn, r.fp, r.fn) for r in d.collect()) for d in (M.threshold_sweep(df), M.threshold_sweep(df, "regime")))
    assert a == b


def test_transition_conflict_is_uncertain(spark):
    df = spark.createDataFrame([("t", "positive", "positive", 0.5), ("t", "positive", "negative", 2.0), (None, "positive", "positive", 1.0)], "transition_id string, truth string, prediction string, confidence double")
    assert [tuple(r) for r in M.collapse_transitions(df).collect()] == [("t", "positive", "uncertain", 0.5)]


# ---- evidence

@pytest.mark.parametrize(("readings", "inherited", "want"), [
    (["1:00"], None, ("direct", "1:00")), (["1:00", "1:00"], None, ("temporally_plausible", "1:00")), (["1:00", "1:01"], None, ("rejected", None)), (["1:00", ""], None, ("rejected", None)),
    (["", None], "0:59", ("inherited", "0:59")), ([None], None, ("missing", None)), (["a", "b", "b"], None, ("temporally_plausible", "b"))])
def test_reconcile_readings(spark, readings, inherited, want):
    df = spark.createDataFrame([(1, r, inherited) for r in readings], "observation_id long, reading string, inherited string")
    row = X.reconcile_readings(df).first()
    assert (row.provenance, row.selected) == want


def test_multiset_and_counters(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "v string") for s in ("aab", "abb"))
    assert not X.multiset_equal(a, b) and X.multiset_equal(a, a.orderBy(F.desc("v")))
    assert sorted(map(tuple, J.multiset_delta(a, b, ["v"]).collect())) == [("a", 1, 0), ("b", 0, 1)]
    counted, seen = X.run_counters(a, "c", n_a=F.count_if(F.col("v") == "a"))
    counted.collect()
    assert seen.get == {"rows": 3, "n_a": 2}


# ---- joins and windows

def vectors(spark, cells):
    return spark.createDataFrame([(1, i, i, [float(c)] * 64) for i, c in enumerate(cells)], "stream_id long, seq long, observation_id long, cells array<double>")


def test_similarity_thresholds_and_buckets(spark):
    v = vectors(spark, [10, 100, 13.4, 100, 13.6, 30])
    assert {r.observation_id: r.h_seq for r in J.similar_state_join(v, v).collect()} == {2: 0, 3: 1, 4: 2}
    near = vectors(spark, [3.9, 100, 4.1])  # other buckets, but neighbours
    assert J.similar_state_join(near, near).count() == 1
    assert J.similar_state_join(v.limit(0), v).collect() == []


def test_complete_radius_equals_exhaustive(spark):
    rng = random.Random(4)
    rows = [(i % 3, i, i, [rng.choice([20.0, 23.0, 60.0]) + rng.random() for _ in range(64)] if i < 30 else None) for i in range(30)]
    rows += [(s, i + 30, i + 30, [min(255.0, c + rng.uniform(-4, 4)) for c in cells]) for s, i, _, cells in rows]
    v = spark.createDataFrame(rows, "stream_id long, seq long, observation_id long, cells array<double>")
    a, b = ({(r.observation_id, r.h_seq) for r in d.collect()} for d in (J.similar_state_join(v, v, radius=2), J.similar_state_exhaustive(v, v)))
    assert a == b and len(a) >= 30


def slow_similar(rows, mode, last=None):
    found = {}
    for s, seq, i, cells in rows:
        for s2, h_seq, _, other in rows:
            if s2 != s or not h_seq < seq - 1 or last is not None and h_seq < seq - last:
                continue
            diff = 0.0
            for x, y in zip(cells, other, strict=True):
                diff += abs(x - y)
            diff /= 64
            if diff < 3.5 and max(abs(x - y) for x, y in zip(cells, other, strict=True)) < 15:
                found.setdefault((s, i), []).append((diff, -h_seq) if mode == "best" else (-h_seq, diff))
    return {k: (-min(v)[1], min(v)[0]) if mode == "best" else (-min(v)[0], min(v)[1]) for k, v in found.items()}


def crowded(spark):
    """Three states and many near and equal ones, in one bucket."""
    rng = random.Random(11)
    heads = [[rng.uniform(110, 130) for _ in range(64)] for _ in range(3)]
    rows = [(i % 2, i, i, [c + (0 if i % 3 else rng.uniform(-6, 6)) for c in rng.choice(heads)]) for i in range(160)]
    return rows, spark.createDataFrame(rows, "stream_id long, seq long, observation_id long, cells array<double>")


@pytest.mark.parametrize("mode", ["best", "most_recent"])
def test_similar_states_of_a_crowded_bucket_meet_in_blocks(spark, monkeypatch, mode):
    rows, v = crowded(spark)
    monkeypatch.setattr("obsline.operators.similar.LEAST", 7)
    df = J.similar_state_join(v, v, radius=2, mode=mode)
    assert {(r.stream_id, r.observation_id): (r.h_seq, r["diff"]) for r in df.collect()} == slow_similar(rows, mode)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # with sizes of blocks; pairs are not joined


@pytest.mark.parametrize("last", [None, 40])
def test_exhaustive_search_meets_in_blocks(spark, monkeypatch, last):
    rows, v = crowded(spark)
    monkeypatch.setattr("obsline.operators.similar.LEAST", 7)
    odd = spark.createDataFrame([(0, 500, 500, [float("nan")] * 64), (0, 600, 600, None), (0, 700, 700, [1.0])], v.schema)
    df = J.similar_state_exhaustive(v.unionByName(odd), v.unionByName(odd), mode="most_recent", last=last)
    assert {(r.stream_id, r.observation_id): (r.h_seq, r["diff"]) for r in df.collect()} == slow_similar(rows, "most_recent", last)
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_measured_in_small_parts(spark):
    rows = [(1, i, bytes([i % 200] * 768), 16, 16) if i % 7 else (1, i, b"short", 16, 16) for i in range(300)]
    df = spark.createDataFrame(rows, "stream_id long, observation_id long, pixels binary, height int, width int").coalesce(1)
    m = P.measure_frames(df)
    got = {r.observation_id: r for r in m.collect()}
    assert len(got) == 300 and all((got[i].cells is None) == (i % 7 == 0) == (got[i].red_threshold is None) for i in got)
    assert all([round(c, 6) for c in got[i].cells] == [i % 200] * 64 and len(got[i].red) == 256 == len(got[i].edges) for i in got if i % 7)
    # Rows leave as Arrow in parts, not as a batch of Python lists; what comes in is bounded by bytes.
    assert "MapInArrow" in m._jdf.queryExecution().optimizedPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_lookahead_pairs_meet_once(spark):
    df = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate((0, 0.5, 0.75, 0.76, 1.5))], "stream_id long, observation_id long, ts timestamp")
    pairs = sorted((r.observation_id, r.r_observation_id) for r in J.lookahead_join(df, df, 0.75).collect())
    assert pairs == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 3), (3, 4), (4, 4)]


def test_sequence_containment(spark):
    g = spark.createDataFrame([("g", i, k) for i, k in enumerate("abcab")], "game_id string, pos long, key string")
    o = spark.createDataFrame([(1, i, k) for i, k in enumerate("ab")] + [(2, i, k) for i, k in enumerate("ac")], "stream_id long, pos long, key string")
    assert sorted(map(tuple, J.contains_sequence(g, o).collect())) == [(1, "g", 0), (1, "g", 3)]


def test_sequences_of_one_key_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "MEETINGS", 1_000, raising=False)
    g = spark.createDataFrame([(f"g{i}", p, k) for i in range(200) for p, k in enumerate("abab")], "game_id string, pos long, key string")
    o = spark.createDataFrame([(i, p, k) for i in range(60) for p, k in enumerate("ab" if i % 3 else "b")], "stream_id long, pos long, key string")
    df = J.contains_sequence(g, o)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 60 * 400 and max(tasks) < 60 * 400 / 3
    got = {(r.stream_id, r.game_id, r.start) for r in df.collect()}
    assert got == {(i, f"g{n}", p + (0 if i % 3 else 1)) for i in range(60) for n in range(200) for p in (0, 2)}


def test_bundles_are_written_compressed_and_whole(spark, tmp_path):
    rows = [(i, ("report", "events", "summary")[i % 3], '{"event": "ACCEPT", "state": "x\\"y", "n": %d}' % i) for i in range(3_000)]
    S.write_bundle(spark.createDataFrame(rows, "report_id long, part string, body string").coalesce(1), str(tmp_path / "b"))
    size = sum(f.stat().st_size for f in (tmp_path / "b").rglob("part-*"))
    assert size < sum(len(body) for _, _, body in rows) / 3
    assert sorted((r.report_id, r.part, r.body) for r in S.read_bundle(spark, str(tmp_path / "b")).collect()) == rows


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(7)
    rows = [(i % 4, i, at(i // 3), float(i % 11)) for i in range(200)]
    wanted = None
    for n in (1, 2, 8):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = spark.createDataFrame(rows, "stream_id long, observation_id long, ts timestamp, value double").repartition(n)
        got = (sorted(map(str, W.monotonic_check(df, "value").collect())), sorted(map(str, W.coalesce_bursts(df, 1.5).collect())), sorted(map(str, J.compare_by_position(df, df.filter("observation_id % 7 > 0"), "value").collect())))
        wanted = wanted or got
        assert got == wanted
    spark.conf.set("spark.sql.shuffle.partitions", "8")


# ---- branches

BRANCHES = "stream_id long, branch_id long, parent_seq long, step long, state string, next_state string, move string, ts timestamp, score double"


def branch(i, parent, moves, start=100.0, score=70.0, root="s0"):
    states = [root, *(f"{i}-{k}" for k in range(len(moves)))]
    return [(1, i, parent, k, states[k], states[k + 1], m, at(start + k), score) for k, m in enumerate(moves)]


def main_line(spark, moves="abcd"):
    return spark.createDataFrame([(1, k, f"s{k}", m, at(k)) for k, m in enumerate(moves)], "stream_id long, seq long, state string, move string, ts timestamp")


def ids(df):
    return sorted({r.branch_id for r in df.collect()})


def test_branch_filters(spark):
    line = main_line(spark)
    replay = [(1, 1, 1, k, f"s{k + 1}", f"s{k + 2}", m, at(50 + k), 70.0) for k, m in enumerate("bc")]
    rows = [*replay, *branch(2, 1, "bx", root="s1"), *branch(3, 1, "b", root="s1"), *branch(4, 0, "q", score=10.0), *branch(5, 0, "qr", score=10.0), *branch(6, 2, "x", root="lost")]
    b = spark.createDataFrame(rows, BRANCHES)
    assert ids(B.exact_replay_filter(b, line)) == [2, 4, 5, 6]
    assert ids(B.prefix_supersede(b)) == [1, 2, 5]  # 2 covers 6 from its second step on
    assert ids(B.weak_branch_filter(b)) == [1, 2, 3, 4, 6]
    assert ids(B.known_root_filter(b, line)) == [1, 2, 3, 4, 5]
    trimmed = {(r.branch_id, r.parent_seq, r.step, r.move) for r in B.trim_shared_prefix(b, line).collect()}
    assert (2, 2, 0, "x") in trimmed and not any(t[0] in (1, 3) for t in trimmed)
    assert ids(B.reanchor_branches(b, line)) == [1, 2, 3, 4, 5]
    found = {r.branch_id: (r.steps, r.matches) for r in B.lcs_replay_test(b, line).collect()}
    assert found[1] == (2, 2) and found[2] == (2, 1) and found[4] == (1, 0)
    for f in (B.weak_branch_filter, B.prefix_supersede, B.clear_unread_branch_readings, B.join_continuations):
        assert f(b.limit(0).withColumn("reading", F.lit("")).withColumn("terminal", F.lit(True))).collect() == []


def test_continuations_join_in_chains(spark):
    rows, root = [], "s0"
    for i in range(6):
        part = branch(i, 0 if i == 0 else 90 + i, "ab", start=10.0 + 10 * i, root=root)
        rows += part
        root = part[-1][5]
    found = B.join_continuations(spark.createDataFrame(rows, BRANCHES)).orderBy("step").collect()
    assert [(r.branch_id, r.parent_seq, r.step) for r in found] == [(0, 0, k) for k in range(12)]


def test_orphan_fork_goes_under_its_branch(spark):
    rows = branch(1, 2, "abc", root="s2") + branch(2, 9, "z", root="1-0") + branch(3, 9, "z", root="nowhere")
    found = {(r.branch_id, r.under, r.under_step) for r in B.flatten_orphan_forks(spark.createDataFrame(rows, BRANCHES), main_line(spark)).collect()}
    assert found == {(1, None, None), (2, 1, 1)}


# ---- machines

def test_bursts_emit_each_reason():
    m = machines.Bursts()
    rows = [(0.0, False, False), (0.1, True, False), (0.2, True, False), (0.3, True, False), (0.4, True, False), (0.5, True, False), (0.6, True, True), (0.7, False, False), (0.8, False, False), (0.9, False, False)]
    out = [(r["reason"], r["observation_id"]) for i, (t, a, b) in enumerate(rows) for r in m.step({"ts": t, "observation_id": i, "has_motion": a, "motion_spike": b})]
    assert out == [("initial_frame", 0), ("motion_leading_edge", 1), ("motion_burst_cap", 4), ("motion_spike_prev_frame", 5), ("settled_tail", 8)]
    m = machines.Bursts()
    rows = [(0.0, False, False), (0.1, True, False), (0.2, True, False), (0.3, True, True)]
    assert [(r["reason"], r["observation_id"]) for i, (t, a, b) in enumerate(rows) for r in m.step({"ts": t, "observation_id": i, "has_motion": a, "motion_spike": b})][-1] == ("motion_spike_prev_frame", 2)


def cells(x):
    return [float(x)] * 64


def step(m, ts, x, **more):
    row = {"ts": ts, "observation_id": int(ts * 10), "cells": cells(x), "stable": True, "move": "e2e4", "score": 80.0, "origin": 40.0, "target": 50.0, "allowed": True, "changed": 2}
    return m.step({**row, **more})


def test_reducer_rules():
    m = machines.Reducer()
    assert [r["event"] for r in step(m, 0, 10)] == ["INITIAL"]
    assert step(m, 1, 12)[0]["event"] == "QUIET"
    assert step(m, 2, 60, stable=False)[0]["event"] == "REJECTED_FRAME"
    assert step(m, 3, 60, score=20.0)[0]["reason"] == "score_threshold"
    assert step(m, 4, 60, allowed=False)[0]["reason"] == "illegal_move"
    assert step(m, 5, 60, origin=10.0)[0]["reason"] == "missing_yellow"
    assert step(m, 6, 60, hover=True, score=50.0)[0]["reason"] == "hover_box"
    assert step(m, 7, 60)[0]["event"] == "ACCEPT" and m.seq == 1
    assert step(m, 8, 110, move="e4e2", score=50.0)[0]["reason"] == "inverse_validation"
    assert step(m, 9, 110, move="d7d5")[0]["event"] == "ACCEPT" and m.seq == 2
    assert step(m, 10, 61, bounces=True)[0]["event"] == "REVERT_SEARCH"
    back = step(m, 20, 11)
    assert [r["event"] for r in back] == ["REVERT_APPLIED", "VARIATION", "VARIATION"] and back[0]["target_seq"] == 0 and m.seq == 0 and m.generation == 1
    assert len(m.history) == 1


def test_reducer_reading_vetoes():
    m = machines.Reducer()
    step(m, 0, 10)
    step(m, 1, 60, side="w", seconds=100)
    base = {"move": "a2a3", "side": "w", "active_side": "w", "observed": 2, "agreeing": 2}
    assert step(m, 2, 110, seconds=100, **base)[0]["reason"] == "stale_clock"
    m.boundary = False
    assert step(m, 3, 110, seconds=400, **base)[0]["reason"] == "clock_jump"
    assert step(m, 4, 110, seconds=400, **{**base, "active_side": "b"}, regression_confirmed=True)[0]["reason"] in ("confirmed_clock_regression", "pending_clock_vetoed_replay")
    m.boundary = False
    assert step(m, 5, 110, seconds=90, **base)[-1]["event"] == "ACCEPT"


def motion_rows(n=200):
    rng = random.Random(9)
    return [(s, i, 100 + i / 10, rng.random() < 0.5, rng.random() < 0.1) for s in (1, 2, 3) for i in range(n)]


MOTION = "stream_id long, observation_id long, ts double, has_motion boolean, motion_spike boolean"


def test_machines_match_one_stream_at_a_time(spark):
    rows = motion_rows()
    found = sorted((r.stream_id, r.observation_id, r.reason) for r in R.coalesce_bursts(spark.createDataFrame(rows, MOTION).repartition(7)).collect())
    want = []
    for s in (1, 2, 3):
        m = machines.Bursts()
        for r in rows:
            if r[0] == s:
                want += [(s, o["observation_id"], o["reason"]) for o in m.step(dict(zip(("stream_id", "observation_id", "ts", "has_motion", "motion_spike"), r, strict=True)))]
    assert found == sorted(want)
    assert R.coalesce_bursts(spark.createDataFrame([], MOTION)).collect() == []


class SlowReducer(machines.Reducer):
    """The rollback search state by state, without arrays."""

    def _distance(self, a, b):
        gaps = [abs(x - y) for x, y in zip(a, b, strict=True)]
        return max(gaps), sum(gaps) / len(gaps)

    def _rollback(self, row, cells, active_mean):
        lim, best = self.limits, None
        for state in self.history[:-1]:
            top, mean = self._distance(cells, state["cells"])
            if top < lim.match_max and mean < lim.match_mean and (best is None or mean <= best[0] + 1e-12):
                best = (mean, state)
        if best is None or (row["score"] >= 100 and active_mean < best[0] - 0.5):
            return None
        target = best[1]["seq"]
        tail = [x for x in self.history if x["seq"] > target]
        if self.seq - target >= lim.keep_steps and tail and tail[-1]["ts"] - tail[0]["ts"] >= lim.keep_seconds:
            self.preserved = tail
        out = self._out(row, "REVERT_APPLIED", "history_match", target_seq=target)
        for x in tail:
            out += self._out({**row, "move": x["move"], "score": x["score"]}, "VARIATION", "demoted_tail", target_seq=x["seq"])
        self._keep([x for x in self.history if x["seq"] <= target])
        self.seq, self.after_rollback, self.boundary = target, True, False
        self.generation += 1
        return out


def test_verified_timeline_matches_a_slow_search(spark):
    from obsline.plans.flows import reducer_rows

    rows = reducer_rows(spark, "/root/testdata/sf0.001")
    found = sorted((r.stream_id, r.observation_id, r.event, r.seq, r.move or "", r.target_seq or -1) for r in R.verified_timeline(rows).collect())
    want = []
    by = {}
    for r in rows.collect():
        by.setdefault(r.stream_id, []).append(r.asDict())
    for stream, own in by.items():
        m = SlowReducer()
        for r in sorted(own, key=lambda r: (r["ts"], r["observation_id"])):
            want += [(stream, o["observation_id"], o["event"], o["seq"], o["move"] or "", o["target_seq"] or -1) for o in m.step(r)]
    assert found == sorted(want) and {e for _, _, e, *_ in want} >= {"ACCEPT", "REVERT_APPLIED"}


def test_reducer_takes_several_moves_of_one_observation():
    m = machines.Reducer()
    step(m, 0, 10)
    more = [{"move": "e4e5", "score": 90.0}, {"move": "d7d5", "score": 70.0, "origin": 40.0, "target": 50.0}, {"move": "g1f3", "score": 40.0}, {"move": "a2a3", "score": 99.0}]
    found = step(m, 7, 60, next_moves=more)
    assert [(r["event"], r["move"], r["reason"]) for r in found] == [("ACCEPT", "e2e4", "move_accepted"), ("ACCEPT", "d7d5", "move_accepted"), ("COALESCED_STOP", "g1f3", "weak_follow_up")] and m.seq == 2


def test_reducer_recapture_and_handoff():
    m = machines.Reducer()
    step(m, 0, 10)
    step(m, 5, 60)
    assert step(m, 5.5, 110, move="d5e4", score=50.0)[0]["reason"] == "immediate_recapture_not_strong"
    assert step(m, 5.6, 110, move="e4e6")[0]["reason"] == "immediate_recapture_not_strong"
    assert step(m, 5.7, 110, move="d5e4", captures=False)[0]["reason"] == "immediate_recapture_not_strong"
    assert step(m, 5.8, 110, move="d5e4")[0]["event"] == "ACCEPT"
    m = machines.Reducer()
    step(m, 0, 10)
    step(m, 1, 60, side="w", seconds=100)
    base = {"side": "w", "active_side": "w", "observed": 2, "agreeing": 2}
    assert [r["event"] for r in step(m, 3, 110, move="a2a3", seconds=100, **base)] == ["VALIDATION_REJECTED", "HANDOFF_PENDING"]
    m.boundary = False
    assert [r["event"] for r in step(m, 4, 112, move="b7b6", seconds=90, **base)] == ["HISTORICAL_HANDOFF", "ACCEPT"]


def test_nearest_unused_observation(spark):
    day = "2024-01-01 00:00:"
    entries = [(1, i, f"{day}{t:02d}", "m") for i, t in enumerate((10, 12, 30, 50))] + [(2, 9, f"{day}05", "m"), (None, 8, f"{day}05", "m")]
    seen = [(1, 100 + i, f"{day}{t:02d}", "m") for i, t in enumerate((11, 31, 9))] + [(1, 200, f"{day}10", "other"), (None, 300, f"{day}07", "m")]
    a, b = (spark.createDataFrame(x, "stream_id long, observation_id long, t string, transition string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t") for x in (entries, seen))
    found = {r.observation_id: (r.d_id, r.distance) for r in J.nearest_in_time(a, b).collect()}
    assert {i: found[i] for i in (0, 1, 2, 3, 9)} == {0: (102, 1.0), 1: (100, 1.0), 2: (101, 1.0), 3: (None, None), 9: (None, None)}


def test_interior_roots_join(spark):
    def line(branch, parent, states, moves, t):
        return [(1, branch, parent, i, s, m, f"2024-01-01 00:00:{t + i:02d}", 1.0) for i, (s, m) in enumerate(zip(states, moves, strict=True))]

    rows = line(1, 0, "ABCD", "abcd", 0) + line(2, 2, "CXY", "cxy", 10) + line(3, 5, "XQ", "xq", 20) + line(4, 7, "BZ", "pr", 30) + line(5, 9, "K", "k", 40)
    df = spark.createDataFrame(rows, "stream_id long, branch_id long, parent_seq long, step long, state string, move string, t string, score double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    found = {}
    for r in B.join_interiors(df).orderBy("branch_id", "step").collect():
        found.setdefault(r.branch_id, []).append(r.move)
    # 2 starts inside 1 and repeats its c; 3 starts inside 2 and repeats its x; 4 starts inside 1 but shares no move with its rest.
    assert found == {1: ["a", "b", "c", "x", "q"], 4: ["p", "r"], 5: ["k"]}


def fits(branches):
    """All joins that a set of branches {id: (parent, steps)} allows: (outer, inner, cut)."""
    for outer, (_, own) in branches.items():
        for inner, (_, steps) in branches.items():
            cut = next((i for i in range(1, len(own)) if own[i][0] == steps[0][0]), None)
            if inner != outer and cut is not None and {m for _, m in own[cut:]} & {m for _, m in steps}:
                yield outer, inner, cut


def ends(branches):
    """What every order of joins, one at a time, can end in."""
    found, seen, todo = set(), set(), [branches]
    while todo:
        now = todo.pop()
        form = tuple(sorted((k, p, tuple(v)) for k, (p, v) in now.items()))
        if form in seen:
            continue
        seen.add(form)
        moves = list(fits(now))
        if not moves:
            found.add(form)
        for outer, inner, cut in moves:
            then = {k: v for k, v in now.items() if k != inner}
            then[outer] = (now[outer][0], now[outer][1][:cut] + now[inner][1])
            todo.append(then)
    return found


def by_stream(df):
    by = {}
    for r in df.orderBy("step").collect():
        own = by.setdefault(r.stream_id, {}).setdefault(r.branch_id, (r.parent_seq, []))[1]
        assert r.step == len(own)
        own.append((r.state, r.move))
    return by


def interior_frame(spark, streams):
    rows = [(s, k, p, i, state, move) for s, own in streams.items() for k, (p, steps) in own.items() for i, (state, move) in enumerate(steps)]
    return spark.createDataFrame(rows, "stream_id long, branch_id long, parent_seq long, step long, state string, move string")


def test_interior_joins_end_as_some_order_of_single_joins_in_few_turns(spark, monkeypatch):
    rng = random.Random(4)
    streams = {s: {k: (k, [(rng.choice("ABCD"), rng.choice("mnop")) for _ in range(rng.randint(1, 4))]) for k in range(4)} for s in range(10)}
    n, chains = 8, {}
    for s, ids in ((100, list(range(n))[::-1]), (101, rng.sample(range(n), n))):
        # Each branch starts inside the one before it, with the move that was made there.
        chains[s] = {ids[i]: (i, [(f"s{i}", f"m{i}"), (f"s{i + 1}", f"m{i + 1}"), (f"t{i}", "stale")]) for i in range(n)}
        streams[s] = chains[s]
    streams[102] = {k: (k, [("X", "a"), (f"y{k}", "b"), ("X", "a"), (f"z{k}", "c")]) for k in range(4)}  # one root, inside of all
    turns, real = [], B._interior_links
    monkeypatch.setattr(B, "_interior_links", lambda current, turn: turns.append(turn) or real(current, turn))
    found = by_stream(B.join_interiors(interior_frame(spark, streams).repartition(5, "state")))
    for s in range(10):
        assert tuple(sorted((k, p, tuple(v)) for k, (p, v) in found[s].items())) in ends(streams[s]), streams[s]
    for s, own in chains.items():
        head = next(k for k, (p, _) in own.items() if p == 0)
        assert found[s] == {head: (0, [*((f"s{i}", f"m{i}") for i in range(n + 1)), (f"t{n - 1}", "stale")])}
    assert len(found[102]) == 1 and not list(fits(found[102]))
    assert len(turns) <= 7


def test_interior_joins_of_the_tables_are_complete(spark):
    from obsline.plans.matching import branch_tables

    _, b = branch_tables(spark, "/root/testdata/sf0.001")
    before, found = by_stream(b), by_stream(B.join_interiors(b))
    assert sum(map(len, found.values())) < sum(map(len, before.values()))
    for s, own in found.items():
        assert not list(fits(own))
        assert all(p == before[s][k][0] and v[0] == before[s][k][1][0] for k, (p, v) in own.items())


def test_ended_streams_finish_and_leave_no_state(spark, tmp_path):
    kinds = "stream_id long, observation_id long, ts double, move string, score double"
    src, schema = f"{tmp_path}/src", None
    for rows in ([(1, 1, 100.0, "a", 5.0), (2, 1, 100.0, "b", 5.0)], [(2, 2, 5000.0, "b", 9.0)], [(3, 1, 9000.0, "c", 1.0)], [(3, 2, 20000.0, "c", 1.0)], [(3, 3, 20001.0, "d", 1.0)]):
        df = spark.createDataFrame(rows, kinds).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
        df.coalesce(1).write.mode("append").parquet(src)
        schema = df.schema
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("event_time", "10 seconds")
    R.bounded_replay(R.run_stream(stream, lambda: machines.Settle(hold=1.0), idle=3000.0), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.stream_id, r.observation_id, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got[:3] == [(1, 1, "no_future_candidate"), (2, 1, "window_expired"), (2, 2, "no_future_candidate")]


def test_stream_equals_batch(spark, tmp_path):
    rows = motion_rows(120)
    df = spark.createDataFrame(rows, MOTION).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    late = spark.createDataFrame([(s, 10_000, 9000.0, False, False) for s in (1, 2, 3)], MOTION).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    src = f"{tmp_path}/src"
    df.filter("observation_id < 60").repartition(1).write.mode("append").parquet(src)
    df.filter("observation_id >= 60").repartition(1).write.mode("append").parquet(src)
    late.repartition(1).write.mode("append").parquet(src)  # moves the watermark past the rest
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("event_time", "1000 seconds")
    R.bounded_replay(R.run_stream(stream, machines.Bursts), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.stream_id, r.observation_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.stream_id, r.observation_id, r.reason) for r in R.coalesce_bursts(spark.createDataFrame(rows, MOTION)).collect())
    assert got == want


# ---- sources

def test_event_and_observation_readers(spark, tmp_path):
    p = tmp_path / "events.jsonl"
    p.write_text('{"sequence": 1, "event": "ACCEPT", "timestamp": 1.5}\n\nnot json\n[1]\n{"sequence": 2, "event": "QUIET"}\n')
    good, bad = S.read_events(spark, str(p))
    assert sorted(r.sequence for r in good.collect()) == [1, 2] and [r.line for r in bad.orderBy("line").collect()] == ["[1]", "not json"]
    assert sorted(r.line_number for r in S.malformed_lines(spark, str(p)).collect()) == [3, 4]
    q = tmp_path / "obs.jsonl"
    q.write_text('{"stream_id": 1, "timestamp": 61.0, "cells": %s}\n{"timestamp": 2.0, "cells": [1]}\n' % ([1.0] * 64))
    rows = S.read_observations(spark, str(q)).orderBy("stream_id").collect()
    assert [(r.chunk, r.quarantine) for r in rows] == [(0, "cells"), (1, None)] and rows[1].observation_id == (1 << 32) + 61000
    S.write_trace_tsv(good, str(tmp_path / "tsv"))
    assert sorted(r.event for r in S.read_trace_tsv(spark, str(tmp_path / "tsv")).collect()) == ["ACCEPT", "QUIET"]


def test_game_texts(spark):
    text = '[Event "x"]\n[Result "1-0"]\n\n1. e4 { [%clk 0:10:00] } e5 ( 1... c5 ( 1... d5 { (note) } ) ) 1-0\n'
    t = spark.createDataFrame([(1, text), (2, "")], "stream_id long, value string")
    tokens = S.game_tokens(t)
    assert tokens.agg(F.max("depth")).first()[0] == 2 and tokens.orderBy(F.desc("pos")).first().depth == 0
    assert [(r.reading, r.depth) for r in S.game_readings(tokens).collect()] == [("0:10:00", 0)]
    assert {(r.key, r.value) for r in S.game_tags(t).collect()} == {("Event", "x"), ("Result", "1-0")}


def test_frames_are_cropped_by_geometry(spark):
    pixels = bytes(range(4 * 4 * 3))
    df = spark.createDataFrame([(1, bytearray(pixels), 4, 4, 1, 2, 2, 2)], "observation_id long, pixels binary, height int, width int, x int, y int, w int, h int")
    row = S.crop_frames(df).first()
    assert (row.height, row.width, bytes(row.pixels)) == (2, 2, pixels[27:33] + pixels[39:45])


def test_trace_findings(spark):
    rows = [(1, i, at(i), e, m, s, 0, c, 0, o) for i, (e, m, s, c, o) in enumerate([("ACCEPT", "a", "x", 1, "accepted"), ("ACCEPT", "a", "x", 2, "accepted"), ("REVERT_APPLIED", None, "never", None, None), ("VALIDATION_REJECTED", "b", "x", 3, "rejected"), ("VALIDATION_REJECTED", "b", "y", 3, "rejected")])]
    df = spark.createDataFrame(rows, "stream_id long, observation_id long, ts timestamp, event string, move string, state string, branch_id long, candidate_id long, generation long, outcome string")
    assert sorted(r.finding for r in C.trace_invariants(df).collect()) == ["rejected_mutation", "repeated_accept", "unknown_rollback_target"]
    assert C.trace_invariants(df.limit(0)).collect() == []
