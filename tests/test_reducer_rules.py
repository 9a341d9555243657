"""The reducer against a second version of its rules, written from the catalogue: whole states in a plain list, one rule after the other."""

import random
from collections import Counter

from obsline.streaming import machines


def worst(a, b):
    return max(abs(x - y) for x, y in zip(a, b, strict=True))


def mean(a, b):
    return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a)


def known(row, name, other=0.0):
    return other if row.get(name) is None else row[name]


class Timeline:
    """States are (seq, cells, time, move, score); ``log`` gets (observation_id, event, reason, move, target)."""

    def __init__(self):
        self.states, self.log, self.aside, self.vetoed, self.clock = [], [], [], [], {}
        self.at, self.blocked, self.rolled_back = 0, False, False

    def say(self, row, event, reason="", move=None, target=None):
        self.log.append((row["observation_id"], event, reason, row.get("move") if move is None else move, target))

    def remember(self, cells, ts, move, score):
        self.states = [*self.states, (self.at, cells, ts, move, score)][-100:]  # ST13, ST24

    def observe(self, row):
        cells = row["cells"]
        if cells is None or row["stable"] is False:
            return self.say(row, "REJECTED_FRAME", "geometry_unstable")  # R1
        if not self.states:
            self.remember(cells, row["ts"], None, 0)
            return self.say(row, "INITIAL")
        if worst(cells, self.states[-1][1]) < 15:
            return self.say(row, "QUIET")  # R2
        if self.roll_back(row, cells) or self.restore(row, cells):
            return None
        moves = [row, *({**row, **m, "further": True} for m in row.get("next_moves") or [])]
        used = set()
        for n, now in enumerate(moves):
            ends = {now["move"][:2], now["move"][2:]} if now["move"] else set()
            if n and (not ends or ends & used):
                continue  # R7
            reason = self.fault(now, self.states[-1], n > 0)
            if reason and n:
                return self.say(now, "COALESCED_STOP", reason)
            if reason:
                event = {"score_threshold": "SCORE_THRESHOLD_REJECTED", "same_time": "COALESCED_STOP", "weak_follow_up": "COALESCED_STOP"}.get(reason, "VALIDATION_REJECTED")
                self.say(now, event, reason)
                return self.keep_apart(now, reason)
            self.accept(now, cells)
            used |= ends
        return None

    def roll_back(self, row, cells):
        fits = [(mean(cells, s[1]), -n, s) for n, s in enumerate(self.states[:-1]) if worst(cells, s[1]) < 15 and mean(cells, s[1]) < 3.5]
        if not fits:
            return False
        near, _, state = min(fits, key=lambda f: f[:2])
        if known(row, "score") >= 100 and mean(cells, self.states[-1][1]) < near - 0.5:
            return False  # R3
        gone = self.at - state[0]
        if gone >= 8 and row.get("returns_soon"):
            self.say(row, "REVERT_DEFERRED_FOR_ACTIVE_STATE", "flash", target=state[0])  # R4, ST8
        elif gone == 1 and row.get("bounces"):
            self.say(row, "REVERT_SEARCH", "bounce", target=state[0])  # R5
        else:
            tail = [s for s in self.states if s[0] > state[0]]
            if gone >= 20 and tail and tail[-1][2] - tail[0][2] >= 60:
                self.aside = tail  # ST20
            self.say(row, "REVERT_APPLIED", "history_match", target=state[0])
            for s in tail:
                self.log.append((row["observation_id"], "VARIATION", "demoted_tail", s[3], s[0]))  # ST9
            self.states = [s for s in self.states if s[0] <= state[0]]
            self.at, self.rolled_back, self.blocked = state[0], True, False
        return True

    def restore(self, row, cells):
        if not self.aside or self.aside[0][0] != self.at + 1 or worst(cells, self.aside[0][1]) >= 15 or mean(cells, self.aside[0][1]) >= 3.5:
            return False
        self.states = [*self.states, *self.aside][-100:]
        self.at, self.aside = self.aside[-1][0], []
        self.say(row, "PRESERVED_MAINLINE_RESTORED", "next_state_returned")
        return True

    def fault(self, row, active, further):
        move, score, a, b = row["move"], row["score"], known(row, "origin"), known(row, "target")
        age = row["ts"] - active[2]
        again = age <= 0.05 and active[0] > 0
        rules = [
            ("same_time", lambda: again and not further),  # R6
            ("score_threshold", lambda: move is None or score is None or score <= (15 if again else 35)),  # R8
            ("weak_follow_up", lambda: again and score < 60),  # R10
            ("waiting_for_strong_parent_transition", lambda: self.blocked and score < 100),  # R25
            ("inverse_validation", lambda: self.inverse(row, move, score, a, b, age)),  # R11
            ("immediate_recapture_not_strong", lambda: self.touches(row, move, score, a, b, age, active[3])),  # R12
            ("illegal_move", lambda: row.get("allowed") is False),  # R13
            ("incomplete_endpoint_diff", lambda: known(row, "changed", 9) <= 1 and min(known(row, "origin_diff", 9), known(row, "target_diff", 9)) < 6),  # R14
            ("destination_not_settled", lambda: row.get("edge_score") is not None and row["edge_score"] < 8),  # R15
            ("missing_yellow", lambda: not row.get("supported") and (a < 25 or b < 25 or a + b < 70)),  # R16
            ("hover_box", lambda: row.get("hover") and (score < 60 or a < 40 or b < 40 or a + b < 90)),  # R17
            ("weak_coalesced_clock", lambda: again and row.get("active_side") not in (None, "none", row.get("side")) and score < 35),  # R18
        ]
        for reason, broken in rules:
            if broken():
                return reason
        return self.clock_fault(row, score, a, b)

    def inverse(self, row, move, score, a, b, age):
        if move[2:] + move[:2] not in [s[3] for s in self.states[-4:]]:
            return False
        firm = score >= 60 and a >= 35 and b >= 35 and a + b >= 75
        return not firm or bool(row.get("bounces")) or (age < 10 and not row.get("persists"))

    def touches(self, row, move, score, a, b, age, last):
        if age >= 1 or not last or move == last or not {move[:2], move[2:]} & {last[:2], last[2:]}:
            return False
        takes = move[2:] == last[2:] and row.get("captures") is not False
        return not (takes and a >= 25 and b >= 35 and a + b >= 85 and score >= 60)

    def clock_fault(self, row, score, a, b):
        now, before = row.get("seconds"), self.clock.get(row.get("side"))
        strong = score >= 100 and a >= 35 and b >= 35 and a + b >= 100
        if strong or now is None or before is None or known(row, "observed", 0) < 2 or known(row, "agreeing", 0) < 2:
            return None
        runs = row.get("active_side") == row.get("side")
        if now == before and runs:
            return "stale_clock"  # R19
        if now == before and before <= 120 and row.get("future_drop"):
            return "future_clock_drop"  # R20
        if now > before + 65 and before < 600 and runs:
            return "clock_jump"  # R21
        if now - before >= 180 and row.get("regression_confirmed"):
            replay = any(v[3] == row["move"] and row["ts"] - v[2] <= 20 for v in self.vetoed)
            return "pending_clock_vetoed_replay" if replay else "confirmed_clock_regression"  # R23, R22
        if self.vetoed and before < 600 and (now == before or now > before + 65):  # R24
            root = [s[3] for s in self.states if s[0] == self.vetoed[-1][0]]
            return "pending_stale_reference" if root and root[-1] and row["move"][:2] == root[-1][2:4] else "pending_stale_suppressed"
        return None

    def keep_apart(self, row, reason):
        """ST10, ST23."""
        self.vetoed = [v for v in self.vetoed if row["ts"] - v[2] <= 20]
        a, b = known(row, "origin"), known(row, "target")
        if "clock" in reason and row["score"] >= 80 and a >= 30 and b >= 30 and a + b >= 90:
            self.vetoed.append((self.at, row["cells"], row["ts"], row["move"], row["score"], row.get("side"), row.get("seconds")))
            self.blocked = reason == "stale_clock"
            self.say(row, "HANDOFF_PENDING", reason)

    def hands_over(self, row, cells, v):
        """ST17."""
        tail, gain = self.at - v[0], known(row, "source_score", row["score"]) - row["score"]
        there, here = mean(cells, v[1]), mean(cells, self.states[-1][1])
        if tail >= 8 and gain < 25:
            return False
        if there + 0.5 < here:
            return True
        if self.aside and self.aside[0][0] == v[0] + 1 and gain >= 30 and there < here + 2:
            return True
        now, before, active = row.get("seconds"), v[6], self.clock.get(v[5])
        joins = None not in (now, before, active) and abs(now - before) <= 10 and now - active >= 180
        return 2 <= tail <= 4 and row["move"] == v[3] and min(row["score"], v[4]) >= 90 and there < here + 1.75 and joins

    def accept(self, row, cells):
        for v in self.vetoed:
            if row["ts"] - v[2] <= 20 and self.hands_over(row, cells, v):
                self.at += 1
                self.say(row, "HISTORICAL_HANDOFF", "continued", move=v[3])
                self.remember(v[1], v[2], v[3], v[4])
                break
        self.vetoed = []
        self.at += 1
        reading, before = row.get("seconds"), self.clock.get(row.get("side"))
        if self.rolled_back and None not in (reading, before) and before - reading > 180 and before <= 1800:
            reading = before  # R27
        if reading is not None:
            self.clock[row.get("side")] = reading
        self.rolled_back = self.blocked = False
        self.remember(cells, row["ts"], row["move"], row["score"])
        self.say(row, "ACCEPT", "move_accepted")  # R26


def made(seed, n):
    rng = random.Random(seed)
    squares = [f + r for f in "abcd" for r in "1234"]
    maybe = lambda p, v, other=None: v if rng.random() < p else other
    rows, ts, level, clock = [], 0.0, 10.0, {"w": 700, "b": 100}

    def move():
        return "".join(rng.sample(squares, 2))

    last, levels = move(), [10.0]
    for i in range(n):
        ts += rng.choice([0.02, 0.3, 0.7, 1.5, 4.0, 9.0])
        if rng.random() < 0.6:
            level = rng.choice(levels[-25:]) if rng.random() < 0.25 else float(rng.randint(0, 60) * 20)
            levels.append(level)
        side = rng.choice("wb")
        clock[side] = max(0, clock[side] - rng.choice([0, 0, 3, 20]))
        last = rng.choice([move(), last[2:] + last[:2], last[2:] + rng.choice(squares), rng.choice(squares) + last[2:]])
        if last[:2] == last[2:]:
            last = move()
        rows.append({
            "ts": ts, "observation_id": i, "cells": maybe(0.98, [level + rng.random() for _ in range(64)]), "stable": maybe(0.02, False, True), "move": maybe(0.97, last), "score": rng.choice([10.0, 30.0, 50.0, 70.0, 85.0, 95.0, 120.0]),
            "origin": rng.choice([20.0, 36.0, 45.0, 60.0]), "target": rng.choice([20.0, 36.0, 45.0, 60.0]), "allowed": maybe(0.05, False, True), "changed": maybe(0.1, 1, 2), "origin_diff": maybe(0.5, 3.0, 9.0), "target_diff": maybe(0.5, 9.0),
            "edge_score": maybe(0.1, rng.choice([5.0, 9.0])), "supported": maybe(0.5, True, False), "hover": maybe(0.1, True), "side": side, "active_side": maybe(0.9, rng.choice([side, side, "w", "b", "none"])),
            "seconds": maybe(0.9, clock[side] + rng.choice([0, 0, 0, 100, 300])), "observed": maybe(0.9, 2, 1), "agreeing": 2, "returns_soon": maybe(0.3, True), "bounces": maybe(0.3, True, False), "persists": maybe(0.5, True),
            "captures": maybe(0.2, False), "future_drop": maybe(0.5, True), "regression_confirmed": maybe(0.7, True), "source_score": maybe(0.3, rng.choice([60.0, 130.0, 160.0])),
            "next_moves": maybe(0.3, [{"move": move(), "score": rng.choice([20.0, 62.0, 90.0]), "origin": 45.0, "target": 45.0} for _ in range(rng.randint(1, 3))])})
    return rows


def test_reducer_matches_the_catalogue_written_anew():
    seen = Counter()
    for seed in range(60):
        rows = made(seed, 250)
        slow, fast, got = Timeline(), machines.Reducer(), []
        for row in rows:
            slow.observe(dict(row))
            got += [(o["observation_id"], o["event"], o["reason"], o["move"], o["target_seq"]) for o in fast.step(dict(row))]
        assert got == slow.log, seed
        assert [s["seq"] for s in fast.history] == [s[0] for s in slow.states] and fast.readings == slow.clock
        seen.update((e, r) for _, e, r, *_ in got)
    reasons = {r for _, r in seen}
    assert {e for e, _ in seen} >= {"INITIAL", "QUIET", "REJECTED_FRAME", "REVERT_APPLIED", "VARIATION", "REVERT_SEARCH", "REVERT_DEFERRED_FOR_ACTIVE_STATE", "COALESCED_STOP", "ACCEPT", "HANDOFF_PENDING", "HISTORICAL_HANDOFF"}
    assert reasons >= {"score_threshold", "same_time", "weak_follow_up", "waiting_for_strong_parent_transition", "inverse_validation", "immediate_recapture_not_strong", "illegal_move", "incomplete_endpoint_diff",
                       "destination_not_settled", "missing_yellow", "hover_box", "stale_clock", "future_clock_drop", "clock_jump", "confirmed_clock_regression", "pending_clock_vetoed_replay"}


def test_a_long_line_is_kept_aside_and_comes_back():
    rows = [{"ts": 10.0 * i, "observation_id": i, "cells": [20.0 * i] * 64, "stable": True, "move": f"{'abcdefgh'[i % 8]}1{'abcdefgh'[(i + 3) % 8]}{i % 5 + 2}", "score": 120.0, "origin": 50.0, "target": 60.0} for i in range(30)]
    rows += [{**rows[2], "ts": 400.0, "observation_id": 100}, {**rows[3], "ts": 410.0, "observation_id": 101}]
    slow, fast = Timeline(), machines.Reducer()
    got = [(o["observation_id"], o["event"], o["reason"], o["move"], o["target_seq"]) for r in rows for o in fast.step(dict(r))]
    for r in rows:
        slow.observe(dict(r))
    assert got == slow.log and got[-1][1] == "PRESERVED_MAINLINE_RESTORED" and fast.seq == slow.at == 29
