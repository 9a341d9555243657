"""The timeline with its own look-ahead, in a table and in a stream; typed state; counts of late rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from obsline.streaming import machines
from obsline.streaming import run as R
from obsline.streaming.typed import changes

KIND = ("stream_id long, observation_id long, ts double, cells array<double>, stable boolean, move string, score double, origin double, target double, "
        "allowed boolean, changed int, side string, active_side string, seconds double, observed int, agreeing int")
COLUMNS = ("stream_id", "observation_id", "event", "reason", "seq", "move", "generation", "target_seq", "reading")


def flat(x):
    return [float(x)] * 64


def observations(streams=(1, 2), n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for s in streams:
        level, seconds = 10.0, 600.0
        for i in range(n):
            if rng.random() < 0.35:
                level = float(rng.choice([10, 40, 70, 100, 130, 160, 190]))
            if rng.random() < 0.3:
                seconds -= rng.randint(0, 20)
            rows.append((s, i, 100 + i * 0.7, flat(level + rng.random() / 2), rng.random() > 0.03, rng.choice(["e2e4", "d7d5", "e4e2", "g1f3", "b8c6"]),
                         rng.choice([20.0, 50.0, 85.0, 120.0]), 40.0, rng.choice([20.0, 50.0]), rng.random() > 0.1, 2, rng.choice("wb"), rng.choice(["w", "b", "none"]),
                         rng.choice([seconds, seconds, seconds + 200, max(seconds - 30, 0)]), 2, 2))
    return rows


def timed(df):
    return df.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def key(row):
    return tuple(str(row[c]) for c in COLUMNS)


def facts_by_hand(machine, row, rest):
    """The look-ahead facts of one row, follower by follower."""
    def mean(a, b):
        return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a)

    active = machine.history[-1]["cells"].tolist()
    before = machine.readings.get(row["side"])
    found = dict.fromkeys(("returns_soon", "bounces", "persists", "future_drop", "regression_confirmed"), False)
    for f in rest:
        age = f["ts"] - row["ts"]
        if age <= 6 and mean(f["cells"], active) < 4:
            found["returns_soon"] = True
        if age <= 0.75 and mean(f["cells"], active) < 3:
            found["bounces"] = True
        if 1 <= age <= 4 and mean(f["cells"], row["cells"]) < 3:
            found["persists"] = True
        if f["side"] == row["side"] and before is not None:
            if age <= 20 and 0 < before - f["seconds"] <= 90:
                found["future_drop"] = True
            if age <= 4 and f["seconds"] - before >= 180 and abs(f["seconds"] - row["seconds"]) <= 90:
                found["regression_confirmed"] = True
    return found


def test_facts_match_a_slow_look_ahead():
    names = [part.split(" ")[0] for part in KIND.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in observations((1,), 150, 8)]
    held, seen = R.Held(machines.Timeline()), []
    keep = machines.Timeline._with_facts

    def spied(self, row, followers):
        known = keep(self, row, followers)
        if self.history and row["stable"] and row["cells"] == rows[row["observation_id"]]["cells"]:
            at = row["observation_id"]
            rest = [f for f in rows[at + 1 :] if f["ts"] <= row["ts"] + self.LOOK]
            want = facts_by_hand(self, row, rest)
            assert {k: known[k] for k in want} == want
            seen.append(tuple(want.values()))
        return known

    machines.Timeline._with_facts = spied
    try:
        for row in rows:
            held.step(row)
        held.finish()
    finally:
        machines.Timeline._with_facts = keep
    assert len(seen) > 100 and all(any(s[i] for s in seen) for i in range(5))


def test_look_ahead_defers_bounces_and_settles_readings():
    def row(ts, level, **more):
        return {"ts": ts, "observation_id": int(ts * 10), "cells": flat(level), "stable": True, "move": "e2e4", "score": 80.0, "origin": 40.0, "target": 50.0, **more}

    def events(rows):
        held = R.Held(machines.Timeline())
        out = [o for r in rows for o in held.step(r)] + held.finish()
        return [(o["event"], o["reason"]) for o in out if not o["event"].startswith("SETTLE")], held.machine

    line = [row(0, 10), row(5, 60), row(9, 110, move="d7d5")]
    assert events([*line, row(20, 61), row(20.5, 110)])[0][3] == ("REVERT_SEARCH", "bounce")
    assert events([*line, row(20, 61), row(30, 110)])[0][3] == ("REVERT_APPLIED", "history_match")
    clock = {"side": "w", "active_side": "w", "observed": 2, "agreeing": 2}
    first = [row(0, 10), row(5, 60, seconds=100.0, **clock)]
    stale = row(9, 110, move="d7d5", seconds=100.0, **clock)
    assert events([*first, stale])[0][2] == ("VALIDATION_REJECTED", "stale_clock")
    found, machine = events([*first, stale, row(10, 110.5, seconds=93.0, **clock), row(11, 111, seconds=93.0, **clock)])
    assert found[2] == ("ACCEPT", "move_accepted") and machine.readings["w"] == 93.0  # ST18


def cells_with(base, **moved):
    out = flat(base)
    for name, value in moved.items():
        out[machines._cell(name)] = float(value)
    return out


def test_candidates_are_followed_until_they_settle():
    """All outcomes of R9; a retargeted row is accepted with the later cells, so that these are quiet when their turn comes."""
    def row(ts, cells, move=None, score=None):
        return {"ts": ts, "observation_id": int(ts * 10), "cells": cells, "stable": True, "move": move, "score": score, "origin": 40.0, "target": 50.0}

    def events(*rest):
        held = R.Held(machines.Timeline())
        out = [o for r in (row(0, flat(10)), *rest) for o in held.step(r)] + held.finish()
        return [(o["event"], o["reason"], o["move"]) for o in out]

    moving = row(5, cells_with(10, e2=60, e3=60), "e2e3", 50.0)
    landed = row(5.4, cells_with(10, e2=60, e4=60), "e2e4", 90.0)
    assert events(moving, landed) == [("INITIAL", "", None), ("SETTLE_PROBE", "accepted_retarget", "e2e4"), ("SETTLE_RETARGET", "accepted_retarget", "e2e4"), ("ACCEPT", "move_accepted", "e2e4"), ("QUIET", "", "e2e4")]
    assert events(moving)[1] == ("SETTLE_PROBE", "no_future_candidate", "e2e3")
    assert events(moving, row(7, flat(10)))[1] == ("SETTLE_PROBE", "window_expired", "e2e3")
    assert events(moving, row(5.4, moving["cells"], "e2e3", 10.0))[1] == ("SETTLE_PROBE", "below_threshold", "e2e3")
    assert events(moving, row(5.4, moving["cells"], "e2e3", 60.0))[1] == ("SETTLE_PROBE", "candidate_found", "e2e3")
    assert events(moving, row(5.4, cells_with(10, e2=60, e4=60, a7=60), "e2e4", 90.0))[1] == ("SETTLE_PROBE", "rejected_unrelated_motion", "e2e3")
    assert events(row(5, flat(12), "e2e3", 90.0))[1:] == [("QUIET", "", "e2e3")]


def test_a_pending_stale_line_is_told_from_its_reference():
    def step(m, ts, level, move, **more):
        return m.step({"ts": ts, "observation_id": int(ts), "cells": flat(level), "stable": True, "move": move, "score": 80.0, "origin": 40.0, "target": 50.0, "side": "w", "observed": 2, "agreeing": 2, **more})

    for move, reason in (("e4e5", "pending_stale_reference"), ("a2a3", "pending_stale_suppressed")):
        m = machines.Reducer()
        step(m, 0, 10, None)
        step(m, 5, 60, "e2e4", seconds=100)
        assert step(m, 10, 110, "d7d5", seconds=100, active_side="w")[0]["reason"] == "stale_clock"
        m.boundary = False
        assert step(m, 15, 112, move, seconds=100, active_side="b")[0]["reason"] == reason


def test_only_changed_entries_are_written():
    assert changes({(1,): (1,), (2,): (2,)}, {(2,): (3,), (3,): (3,)}) == ({(2,): (3,), (3,): (3,)}, [(1,)])
    m = machines.Reducer()
    for i in range(60):
        before = m.dump()
        m.step({"ts": 10.0 * i, "observation_id": i, "cells": flat(20 * (i + 1)), "stable": True, "move": f"a{i % 7}b{i % 5}", "score": 120.0, "origin": 50.0, "target": 60.0})
        found = [changes(before.get(n, {}), t) for n, t in m.dump().items()]
        assert sum(len(put) + len(gone) for put, gone in found) <= 2
    again = machines.Reducer()
    again.load(m.dump())
    assert again.dump() == m.dump() and len(m.history) > 20


@pytest.mark.parametrize("machine", [machines.Bursts, machines.Sampler, machines.Throttle, machines.Settle])
def test_machines_go_on_from_their_state(machine):
    rng = random.Random(2)
    rows = [{"ts": i * 0.3, "observation_id": i, "has_motion": rng.random() < 0.5, "motion_spike": rng.random() < 0.2, "move": rng.choice(["a", "b", None]), "score": rng.random() * 30} for i in range(80)]
    whole, now, got = machine(), machine(), []
    names = [part.split(" ")[0] for part in machine.VALUES.split(", ") if part]
    for row in rows:
        got.append(now.step(dict(row)))
        values, entries, now = [getattr(now, n) for n in names], now.dump(), machine()
        for n, v in zip(names, values, strict=True):
            setattr(now, n, v)
        now.load({**{n: {} for n in machine.TABLES}, **entries})
    assert got == [whole.step(dict(row)) for row in rows] and any(got)


def test_timeline_of_a_stream_is_that_of_the_table(spark, tmp_path):
    """Restarted from its checkpoint in between; one late row is dropped and counted."""
    df = timed(spark.createDataFrame(observations(), KIND))
    want = sorted(map(key, R.timeline_ahead(df.drop("event_time").repartition(3)).collect()))
    assert len({w[2:4] for w in want}) > 8
    src, late = f"{tmp_path}/src", R.LateRows()
    spark.streams.addListener(late)

    def put(part):
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)

    def go():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("event_time", "5 seconds")
        R.bounded_replay(R.timeline_ahead(stream), f"{tmp_path}/out", f"{tmp_path}/cp")

    put(df.filter("ts < 120"))
    put(df.filter("ts >= 120 AND ts < 150"))
    go()
    assert 0 < spark.read.parquet(f"{tmp_path}/out").count() < len(want)
    put(df.filter("ts >= 150"))
    put(timed(spark.createDataFrame([(1, 20_000, 101.0, *[None] * 13)], KIND)))
    put(timed(spark.createDataFrame([(s, 10_000, 9000.0, *[None] * 13) for s in (1, 2)], KIND)))
    go()
    got = sorted(key(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.observation_id < 10_000)
    assert got == want
    for _ in range(50):
        if sum(late.counts.values()):
            break
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert list(late.counts.values()) == [1] and sum(rows for _, rows in late.progress.values()) == 243


def test_rows_without_a_time_are_left_out(spark):
    rows = [(1, 1, None, *[None] * 13), (None, 2, 5.0, flat(10), True, *[None] * 11)]
    assert [(r.stream_id, r.event) for r in R.timeline_ahead(spark.createDataFrame(rows, KIND)).collect()] == [(None, "INITIAL")]
    assert R.timeline_ahead(spark.createDataFrame([], KIND)).collect() == []
