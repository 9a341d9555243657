"""Small state machines over one stream's rows in time order: ST3-ST5, ST11, ST12.

A machine has ``step(row)`` and ``finish()``, both giving output rows; streaming.run drives the same machine in
batch and in Structured Streaming. A machine with ``LOOK`` above zero gets the rows of so many seconds after each as
well: ``step(row, followers)``.

What a machine remembers is typed: ``VALUES`` are single values, attributes of its own, and ``TABLES`` are entries by key;
``dump`` gives the entries of its tables and ``load`` takes them, each as plain tuples, so that a streaming query
writes those that have changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np

Row = dict[str, Any]
Entries = dict[str, dict[tuple, tuple]]


class Machine:
    """What machines without tables share."""

    LOOK = 0.0
    VALUES = ""
    TABLES: dict[str, tuple[str, str]] = {}

    def dump(self) -> Entries:
        return {}

    def load(self, entries: Entries) -> None:
        pass

    def finish(self) -> list[Row]:
        return []


@dataclass
class Bursts(Machine):
    """W2 / ST3: the five emission reasons, the previous row's emission before a spike included.

    Rows: ts (seconds), observation_id, has_motion, motion_spike.
    """

    cap: float = 0.3
    settle: float = 0.2
    gap: float = 0.02
    last_emit: float | None = None
    pending: bool = False
    quiet: float = 0.0
    before_ts: float | None = None
    before_id: int | None = None

    SCHEMA = "ts double, observation_id long, reason string"
    VALUES = "last_emit double, pending boolean, quiet double, before_ts double, before_id long"

    def _emit(self, ts: float, ident: int, reason: str) -> list[Row]:
        self.last_emit = ts
        return [{"ts": ts, "observation_id": ident, "reason": reason}]

    def step(self, row: Row) -> list[Row]:
        ts, ident, out = row["ts"], row["observation_id"], []
        if self.last_emit is None:
            out = self._emit(ts, ident, "initial_frame")
        elif row["motion_spike"] and self.pending and self.before_ts is not None:
            if self.before_ts > self.last_emit + self.gap:
                out = self._emit(self.before_ts, self.before_id, "motion_spike_prev_frame")
        elif row["has_motion"]:
            if not self.pending and ts > self.last_emit + self.gap:
                out = self._emit(ts, ident, "motion_leading_edge")
            self.pending = True
            if ts - self.last_emit > self.cap:
                out += self._emit(ts, ident, "motion_burst_cap")
        elif self.pending:
            self.quiet += ts - self.before_ts if self.before_ts is not None else 0.0
            if self.quiet >= self.settle - 1e-9:
                out = self._emit(ts, ident, "settled_tail")
                self.pending = False
        if row["has_motion"] or not self.pending:
            self.quiet = 0.0
        self.before_ts, self.before_id = ts, ident
        return out


@dataclass
class Sampler(Machine):
    """ST4: rows at the fine step, or at the coarse one after a quiet while. Rows: ts, observation_id, has_motion."""

    fine: float = 0.1
    coarse: float = 1.0
    quiet_after: float = 2.0
    due: float | None = None
    quiet: float = 0.0
    last: float | None = None

    SCHEMA = "ts double, observation_id long, sampling_step double"
    VALUES = "due double, quiet double, last double"

    def step(self, row: Row) -> list[Row]:
        ts = row["ts"]
        if self.due is not None and ts < self.due - 1e-9:
            return []
        self.quiet = 0.0 if row["has_motion"] or self.last is None else self.quiet + ts - self.last
        step = self.coarse if self.quiet >= self.quiet_after else self.fine
        self.last, self.due = ts, ts + step
        return [{"ts": ts, "observation_id": row["observation_id"], "sampling_step": step}]


@dataclass
class Throttle(Machine):
    """ST12: at most one row in each ``every`` seconds (1 to 30)."""

    every: float = 5.0
    due: float | None = None

    SCHEMA = "ts double, observation_id long"
    VALUES = "due double"

    def step(self, row: Row) -> list[Row]:
        if self.due is not None and row["ts"] < self.due - 1e-9:
            return []
        self.due = row["ts"] + min(max(self.every, 1.0), 30.0)
        return [{"ts": row["ts"], "observation_id": row["observation_id"]}]


@dataclass
class Settle(Machine):
    """ST5: a candidate is held up to ``hold`` seconds; a better one (by ``gain``) takes its place.

    Rows: ts, observation_id, move, score. ST11 is the same with hold 0.75 and no retargeting.
    """

    hold: float = 1.0
    gain: float = 8.0
    retarget: bool = True
    held: Row | None = None

    SCHEMA = "ts double, observation_id long, move string, score double, outcome string"
    TABLES = {"held": ("n int", "ts double, observation_id long, move string, score double")}

    def dump(self) -> Entries:
        return {"held": {(0,): tuple(self.held.values())} if self.held else {}}

    def load(self, entries: Entries) -> None:
        for values in entries["held"].values():
            self.held = dict(zip(("ts", "observation_id", "move", "score"), values, strict=True))

    def _close(self, outcome: str) -> list[Row]:
        row, self.held = self.held, None
        return [{**row, "outcome": outcome}] if row else []

    def step(self, row: Row) -> list[Row]:
        out: list[Row] = []
        if self.held and row["ts"] > self.held["ts"] + self.hold:
            out = self._close("window_expired")
        if row["move"] is None or row["score"] is None:
            return out
        new = {k: row[k] for k in ("ts", "observation_id", "move", "score")}
        if self.held is None:
            self.held = new
        elif row["move"] == self.held["move"]:
            self.held["score"] = max(self.held["score"], row["score"])
            out += self._close("candidate_found")
        elif self.retarget and row["score"] >= self.held["score"] + self.gain:
            self.held = {**new, "ts": self.held["ts"]}
        return out

    def finish(self) -> list[Row]:
        return self._close("no_future_candidate")


@dataclass
class Limits:
    """Thresholds of the reducer's rules."""

    score: float = 35
    next_score: float = 15
    follow_up: float = 60
    quiet: float = 15
    match_max: float = 15
    match_mean: float = 3.5
    far_rollback: int = 8
    bounce_mean: float = 3.0
    ends: float = 25
    pair: float = 70
    history: int = 100
    regression: int = 180
    slack: int = 65
    branch_seconds: float = 20
    keep_steps: int = 20
    keep_seconds: float = 60
    touch_seconds: float = 1.0
    long_tail: int = 8
    handoff_gain: float = 25
    decisive_gain: float = 30
    rejoin: int = 10


@dataclass
class Reducer(Machine):
    """ST6: the verified timeline. Rules R1-R27 in order, but for R9, which needs the rows that follow (Timeline has it, and
    Settle is its form before this machine); what each looks at comes as columns of the row.

    ts, observation_id, cells, stable, move, score, origin, target (end scores), allowed, changed,
    origin_diff, target_diff, edge_score, supported (temporal highlight), hover, side, active_side, seconds
    (the reading), observed and agreeing samples, returns_soon (the active state is back in 6 s),
    bounces (0.75 s), persists (a reverse move stays), captures, future_drop, regression_confirmed, source_score (of the
    transition from the state before a vetoed one), and next_moves: further candidates of the same observation, each with
    move, score, origin and target, and any of the columns above, the strongest first.
    Missing columns count as not known, and a rule without its columns passes.
    """

    limits: Limits = field(default_factory=Limits)
    history: list[Row] = field(default_factory=list)  # ST13, ST24: verified states, bounded
    grid: np.ndarray | None = None  # their cells, a row for each
    seq: int = 0
    generation: int = 0
    branch: list[Row] = field(default_factory=list)  # ST10: vetoed transitions kept apart
    preserved: list[Row] = field(default_factory=list)  # ST20
    readings: dict = field(default_factory=dict)
    boundary: bool = False  # ST23
    after_rollback: bool = False

    SCHEMA = "ts double, observation_id long, event string, reason string, seq long, move string, score double, generation long, target_seq long, reading long"

    VALUES = "seq long, generation long, boundary boolean, after_rollback boolean"
    _LINE = ("ts", "move", "side", "seconds", "score", "cells")
    _KIND = "ts double, move string, side string, seconds double, score double, cells array<double>"
    TABLES = {"history": ("seq long", _KIND), "preserved": ("seq long", _KIND), "branch": ("n int", f"seq long, {_KIND}"), "readings": ("side string", "seconds double")}

    def dump(self) -> Entries:
        def line(s: Row) -> tuple:
            return tuple(s["cells"].tolist() if c == "cells" else s.get(c) for c in self._LINE)

        return {
            "history": {(s["seq"],): line(s) for s in self.history}, "preserved": {(s["seq"],): line(s) for s in self.preserved},
            "branch": {(n,): (b["seq"], *line(b)) for n, b in enumerate(self.branch)},
            "readings": {("" if side is None else "=" + side,): (seconds,) for side, seconds in self.readings.items()}}

    def load(self, entries: Entries) -> None:
        def lines(name: str) -> list[Row]:
            found = []
            for key, values in sorted(entries[name].items()):
                seq, rest = (values[0], values[1:]) if name == "branch" else (key[0], values)
                found.append({"seq": seq, **dict(zip(self._LINE, rest, strict=True)), "cells": np.array(rest[-1], float)})
            return found

        self.preserved, self.branch = lines("preserved"), lines("branch")
        if entries["history"]:
            self._keep(lines("history"))
        self.readings = {key[0][1:] or None: values[0] for key, values in entries["readings"].items()}

    def _out(self, row: Row, event: str, reason: str = "", **more: Any) -> list[Row]:
        return [{"ts": row["ts"], "observation_id": row["observation_id"], "event": event, "reason": reason, "seq": self.seq, "move": row.get("move"),
                 "score": row.get("score"), "generation": self.generation, "target_seq": None, "reading": None, **more}]

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        gaps = np.abs(a - b)
        return float(gaps.max()), float(gaps.mean())

    def _keep(self, states: list[Row]) -> None:
        self.history = states[-self.limits.history :]
        self.grid = np.stack([s["cells"] for s in self.history])

    def step(self, row: Row) -> list[Row]:
        lim = self.limits
        cells = row.get("cells")
        if cells is None or row.get("stable") is False:
            return self._out(row, "REJECTED_FRAME", "geometry_unstable")  # R1
        cells = np.asarray(cells, float)
        if not self.history:
            self._verify({**row, "move": None, "score": None}, cells)  # no transition led here
            return self._out(row, "INITIAL")
        active = self.history[-1]
        top, mean = self._distance(cells, active["cells"])
        if top < lim.quiet:
            return self._out(row, "QUIET")  # R2
        out = self._rollback(row, cells, mean)  # R3-R5, ST7, ST8, ST20
        if out is not None:
            return out
        out = self._restore(row, cells)
        if out is not None:
            return out
        reason = self._reject(row, active)
        if reason is None:
            return self._accept(row, cells) + self._coalesced(row, cells)
        event = "SCORE_THRESHOLD_REJECTED" if reason == "score_threshold" else "COALESCED_STOP" if reason in ("same_time", "weak_follow_up") else "VALIDATION_REJECTED"
        out = self._out(row, event, reason)
        return out + self._speculate(row, reason)

    def _coalesced(self, row: Row, cells: np.ndarray) -> list[Row]:
        """The loop over further transitions of one observation: R7 leaves out those that use a cell again."""
        out: list[Row] = []
        used = {row["move"][:2], row["move"][2:4]}
        further = row.get("next_moves")
        for found in [] if further is None else further:
            candidate = dict(found) if isinstance(found, dict) else found.asDict()
            if candidate.get("move") is None or {candidate["move"][:2], candidate["move"][2:4]} & used:
                continue  # R7
            now = {**row, **candidate, "coalesced": True, "next_moves": None}
            reason = self._reject(now, self.history[-1])
            if reason is not None:
                return out + self._out(now, "COALESCED_STOP", reason)
            used |= {now["move"][:2], now["move"][2:4]}
            out += self._accept(now, cells)
        return out

    def _verify(self, row: Row, cells: np.ndarray) -> None:
        self._keep([*self.history, {"seq": self.seq, "cells": cells, "ts": row["ts"], "move": row.get("move"), "side": row.get("side"), "seconds": row.get("seconds"), "score": row.get("score") or 0.0}])

    def _rollback(self, row: Row, cells: np.ndarray, active_mean: float) -> list[Row] | None:
        lim = self.limits
        gaps = np.abs(self.grid[:-1] - cells)
        means = np.where(gaps.max(axis=1, initial=0) < lim.match_max, gaps.mean(axis=1), np.inf) if len(gaps) else np.zeros(0)
        if not (means < lim.match_mean).any():
            return None
        at = len(means) - 1 - int(np.argmin(means[::-1]))  # the latest of the nearest
        best = (float(means[at]), self.history[at])
        if (row.get("score") or 0) >= 100 and active_mean < best[0] - 0.5:
            return None  # R3: a strong transition from a nearer active state comes first
        steps = self.seq - best[1]["seq"]
        if steps >= lim.far_rollback and row.get("returns_soon"):
            return self._out(row, "REVERT_DEFERRED_FOR_ACTIVE_STATE", "flash", target_seq=best[1]["seq"])  # R4
        if steps == 1 and row.get("bounces"):
            return self._out(row, "REVERT_SEARCH", "bounce", target_seq=best[1]["seq"])  # R5
        target = best[1]["seq"]
        tail = [s for s in self.history if s["seq"] > target]
        if steps >= lim.keep_steps and tail and tail[-1]["ts"] - tail[0]["ts"] >= lim.keep_seconds:
            self.preserved = tail  # ST20
        out = self._out(row, "REVERT_APPLIED", "history_match", target_seq=target)
        for s in tail:  # ST9: the tail becomes a branch
            out += self._out({**row, "move": s["move"], "score": s["score"]}, "VARIATION", "demoted_tail", target_seq=s["seq"])
        self._keep([s for s in self.history if s["seq"] <= target])
        self.seq, self.after_rollback = target, True
        self.generation += 1
        self.boundary = False
        return out

    def _restore(self, row: Row, cells: np.ndarray) -> list[Row] | None:
        if self.preserved:
            top, mean = self._distance(cells, self.preserved[0]["cells"])
            if top < self.limits.match_max and mean < self.limits.match_mean and self.preserved[0]["seq"] == self.seq + 1:
                self._keep(self.history + self.preserved)
                self.seq, self.preserved = self.preserved[-1]["seq"], []
                return self._out(row, "PRESERVED_MAINLINE_RESTORED", "next_state_returned")
        return None

    def _reject(self, row: Row, active: Row) -> str | None:
        """The first rule that a transition fails, or None."""
        lim, move, score = self.limits, row.get("move"), row.get("score")
        origin, target = row.get("origin") or 0.0, row.get("target") or 0.0
        same_time = row["ts"] - active["ts"] <= 0.05 and active["seq"] > 0
        if same_time and not row.get("coalesced"):
            return "same_time"  # R6
        if move is None or score is None or score <= (lim.next_score if same_time else lim.score):
            return "score_threshold"  # R8
        if same_time and score < lim.follow_up:
            return "weak_follow_up"  # R10
        if self.boundary and score < 100:
            return "waiting_for_strong_parent_transition"  # R25
        recent = [s["move"] for s in self.history[-4:] if s["move"]]
        if move[2:4] + move[:2] in recent:
            firm = score >= 60 and origin >= 35 and target >= 35 and origin + target >= 75
            if not (firm and not row.get("bounces") and (row["ts"] - active["ts"] >= 10 or row.get("persists"))):
                return "inverse_validation"  # R11
        young = row["ts"] - active["ts"] < lim.touch_seconds
        if young and active["move"] and move != active["move"] and {move[:2], move[2:4]} & {active["move"][:2], active["move"][2:4]}:
            takes = move[2:4] == active["move"][2:4] and row.get("captures") is not False
            if not (takes and origin >= 25 and target >= 35 and origin + target >= 85 and score >= 60):
                return "immediate_recapture_not_strong"  # R12
        if row.get("allowed") is False:
            return "illegal_move"  # R13
        if (row.get("changed") if row.get("changed") is not None else 9) <= 1 and min(row.get("origin_diff") or 9, row.get("target_diff") or 9) < 6:
            return "incomplete_endpoint_diff"  # R14
        if row.get("edge_score") is not None and row["edge_score"] < 8:
            return "destination_not_settled"  # R15
        if not (origin >= lim.ends and target >= lim.ends and origin + target >= lim.pair) and not row.get("supported"):
            return "missing_yellow"  # R16
        if row.get("hover") and not (score >= 60 and origin >= 40 and target >= 40 and origin + target >= 90):
            return "hover_box"  # R17
        return self._reading_veto(row, active, same_time)

    def _reading_veto(self, row: Row, active: Row, same_time: bool) -> str | None:
        lim, score = self.limits, row["score"]
        origin, target = row.get("origin") or 0.0, row.get("target") or 0.0
        if same_time and row.get("active_side") not in (None, "none", row.get("side")) and score < 35:
            return "weak_coalesced_clock"  # R18
        now, before = row.get("seconds"), self.readings.get(row.get("side"))
        if score >= 100 and origin >= 35 and target >= 35 and origin + target >= 100:
            return None  # P13: strong enough without the reading
        reliable = (row.get("observed") or 0) >= 2 and (row.get("agreeing") or 0) >= 2  # P19
        if now is None or before is None or not reliable:
            return None
        if now == before:
            if row.get("active_side") == row.get("side"):
                return "stale_clock"  # R19
            if before <= 120 and row.get("future_drop"):
                return "future_clock_drop"  # R20
        if now > before + lim.slack and before < 600 and row.get("active_side") == row.get("side"):
            return "clock_jump"  # R21
        if now - before >= lim.regression and row.get("regression_confirmed"):
            if any(b["move"] == row["move"] and row["ts"] - b["ts"] <= lim.branch_seconds for b in self.branch):
                return "pending_clock_vetoed_replay"  # R23
            return "confirmed_clock_regression"  # R22
        if self.branch and before < 600 and (now == before or now > before + lim.slack):  # R24: low on time, and a line vetoed before is pending
            before_it = next((s["move"] for s in reversed(self.history) if s["seq"] == self.branch[-1]["seq"]), None)
            return "pending_stale_reference" if before_it and row["move"][:2] == before_it[2:4] else "pending_stale_suppressed"
        return None

    def _speculate(self, row: Row, reason: str) -> list[Row]:
        """ST10: a strong transition that a reading vetoed waits for a handoff."""
        lim, out = self.limits, []
        self.branch = [b for b in self.branch if row["ts"] - b["ts"] <= lim.branch_seconds]
        if "clock" in reason and row["score"] >= 80 and (row.get("origin") or 0) >= 30 and (row.get("target") or 0) >= 30 and row["origin"] + row["target"] >= 90:
            self.branch.append({"ts": row["ts"], "move": row["move"], "cells": np.asarray(row["cells"], float), "score": row["score"], "seq": self.seq, "side": row.get("side"), "seconds": row.get("seconds")})
            self.boundary = reason in ("stale_clock", "pending_stale_suppressed", "pending_stale_reference")  # ST23
            out = self._out(row, "HANDOFF_PENDING", reason)
        return out

    def _handoff(self, row: Row, cells: np.ndarray, b: Row) -> bool:
        """ST17: whether the line of a vetoed transition explains the observation better than the active one."""
        lim, tail = self.limits, self.seq - b["seq"]
        gain = (row.get("source_score") if row.get("source_score") is not None else row["score"]) - row["score"]
        if tail >= lim.long_tail and gain < lim.handoff_gain:
            return False
        there, here = self._distance(cells, b["cells"])[1], self._distance(cells, self.history[-1]["cells"])[1]
        now, before, active = row.get("seconds"), b["seconds"], self.readings.get(b["side"])
        rejoins = None not in (now, before, active) and abs(now - before) <= lim.rejoin and now - active >= lim.regression
        decisive = bool(self.preserved) and self.preserved[0]["seq"] == b["seq"] + 1 and gain >= lim.decisive_gain and there < here + 2
        again = 2 <= tail <= 4 and row["move"] == b["move"] and min(row["score"], b["score"]) >= 90 and there < here + 1.75 and rejoins
        return there + 0.5 < here or decisive or again

    def _accept(self, row: Row, cells: np.ndarray) -> list[Row]:
        out: list[Row] = []
        for b in self.branch:  # ST17: the line that continues a vetoed transition takes over
            if row["ts"] - b["ts"] <= self.limits.branch_seconds and self._handoff(row, cells, b):
                self.seq += 1
                out += self._out({**row, "move": b["move"], "score": b["score"]}, "HISTORICAL_HANDOFF", "continued")
                self._verify({**row, "ts": b["ts"], "move": b["move"], "score": b["score"]}, b["cells"])
                break
        self.branch = []
        self.seq += 1
        reading, side = row.get("seconds"), row.get("side")
        before = self.readings.get(side)
        if self.after_rollback and reading is not None and before is not None and before - reading > 180 and before <= 1800:
            reading = before  # R27
        if reading is not None:
            self.readings[side] = reading
        self.after_rollback = self.boundary = False
        self._verify(row, cells)
        return out + self._out(row, "ACCEPT", "move_accepted", reading=reading)  # R26


def _cell(name: str) -> int:
    """The cell that a name such as e4 stands for; -1 for other names."""
    return ord(name[0]) - 97 + 8 * (ord(name[1]) - 49) if len(name) == 2 and "a" <= name[0] <= "h" and "1" <= name[1] <= "8" else -1


@dataclass
class Look:
    """How far the timeline looks ahead, in seconds, and what it looks for."""

    resume: float = 6.0  # R4, ST8: the active state is back ...
    resume_mean: float = 4.0  # ... within this mean difference
    bounce: float = 0.75  # R5
    persist_from: float = 1.0  # R11: the state after a reverse move is still there
    persist_to: float = 4.0
    drop: float = 20.0  # R20: a lower reading follows
    most_drop: float = 90
    confirm: float = 4.0  # R22: a regression is read again
    spread: float = 90
    settle: float = 4.0  # ST18: a changed, plausible reading
    follow: float = 1.0  # R9, ST5: a candidate is followed until it has settled ...
    gain: float = 8.0  # ... and a later one takes its place if it is better by so much
    unrelated: float = 25.0  # ... unless another cell moves by more than this

    @property
    def farthest(self) -> float:
        return max(self.resume, self.bounce, self.persist_to, self.drop, self.confirm, self.settle, self.follow)


@dataclass
class Timeline(Reducer):
    """ST6 with its look-ahead: R9 (ST5), ST8, ST18 and the facts of R4, R5, R11, R20 and R22 come from the rows that follow.

    Rows are those of Reducer. What a row brings itself (returns_soon, bounces, persists, future_drop, regression_confirmed)
    is kept; what it lacks is looked up among the rows up to ``look.farthest`` seconds after it, against the states
    and readings that are verified when its turn comes.
    """

    look: Look = field(default_factory=Look)

    @property
    def LOOK(self) -> float:  # noqa: N802
        return self.look.farthest

    def step(self, row: Row, followers: list[Row] = ()) -> list[Row]:
        row, out = self._followed(row, followers)
        return out + super().step(self._with_facts(row, followers))

    def _followed(self, row: Row, followers: list[Row]) -> tuple[Row, list[Row]]:
        """R9, ST5: the candidate that the rows of the next second settle on, with SETTLE_PROBE and SETTLE_RETARGET events.

        A retargeted row keeps its time and id and takes the later row's cells and candidate. Outcomes: window_expired, candidate_found, accepted_retarget,
        rejected_unrelated_motion, below_threshold, no_future_candidate.
        """
        look, lim = self.look, self.limits
        if not self.history or row.get("cells") is None or row.get("stable") is False or row.get("move") is None or (row.get("score") or 0) <= lim.score:
            return row, []
        active = self.history[-1]["cells"]
        if self._distance(np.asarray(row["cells"], float), active)[0] < lim.quiet:
            return row, []
        best, outcome, out = row, None, []
        for f in followers:
            if f["ts"] - row["ts"] > look.follow:
                outcome = outcome or "window_expired"
                break
            if f.get("cells") is None or f.get("stable") is False:
                continue
            kept = outcome == "accepted_retarget"
            if f.get("move") is None or (f.get("score") or 0) <= lim.score:
                outcome = outcome if kept else "below_threshold"
                continue
            own = {_cell(m[i : i + 2]) for m in (best["move"], f["move"]) for i in (0, 2)}
            gaps = np.abs(np.asarray(f["cells"], float) - active)
            if any(gap > look.unrelated and i not in own for i, gap in enumerate(gaps.tolist())):
                outcome = outcome if kept else "rejected_unrelated_motion"
                break
            if f["move"] != best["move"] and f["score"] >= best["score"] + look.gain:
                best = {**best, **{k: f.get(k) for k in ("move", "score", "origin", "target", "cells")}}
                outcome = "accepted_retarget"
                out += self._out(best, "SETTLE_RETARGET", outcome)
            elif not kept:
                outcome = "candidate_found"
        return best, self._out(best, "SETTLE_PROBE", outcome or "no_future_candidate") + out

    def _with_facts(self, row: Row, followers: list[Row]) -> Row:
        look, lim, cells = self.look, self.limits, row.get("cells")
        if cells is None or not self.history:
            return row
        seen = [(f["ts"] - row["ts"], np.asarray(f["cells"], float)) for f in followers if f.get("cells") is not None]
        age = np.array([a for a, _ in seen])
        grid = np.stack([c for _, c in seen]) if seen else np.zeros((0, len(cells)))
        to_active = np.abs(grid - self.history[-1]["cells"]).mean(axis=1)
        to_own = np.abs(grid - np.asarray(cells, float)).mean(axis=1)
        side, now = row.get("side"), row.get("seconds")
        before = self.readings.get(side)
        later = [(f["ts"] - row["ts"], f["seconds"]) for f in followers if f.get("side") == side and f.get("seconds") is not None]
        facts = {
            "returns_soon": bool(((age <= look.resume) & (to_active < look.resume_mean)).any()),
            "bounces": bool(((age <= look.bounce) & (to_active < lim.bounce_mean)).any()),
            "persists": bool(((age >= look.persist_from) & (age <= look.persist_to) & (to_own < lim.bounce_mean)).any()),
            "future_drop": before is not None and any(a <= look.drop and 0 < before - s <= look.most_drop for a, s in later),
            "regression_confirmed": None not in (before, now) and any(
                a <= look.confirm and s - before >= lim.regression and abs(s - now) <= look.spread for a, s in later),
        }
        known = {**row, **{k: v for k, v in facts.items() if row.get(k) is None}}
        if before is not None and now is not None and (now == before or now > before + lim.slack or row.get("active_side") == side):
            self._settle(known, followers, side, before)
        return known

    def _settle(self, row: Row, followers: list[Row], side: Any, before: float) -> None:
        """ST18: the reading that most of the rows up to a rollback agree on, of those that have changed and are plausible."""
        counts: dict[float, int] = {}
        for f in followers:
            if f["ts"] - row["ts"] > self.look.settle or (f.get("cells") is not None and self._matches(np.asarray(f["cells"], float))):
                break
            s = f.get("seconds")
            if f.get("side") == side and s is not None and s != before and s <= before + self.limits.slack:
                counts[s] = counts.get(s, 0) + 1
        if counts:
            agreeing, seconds = max((n, s) for s, n in counts.items())
            if agreeing >= 2:
                row["seconds"], row["agreeing"], row["observed"] = seconds, agreeing, sum(counts.values())

    def _matches(self, cells: np.ndarray) -> bool:
        """Whether cells are those of an earlier state."""
        gaps = np.abs(self.grid[:-1] - cells)
        return bool(((gaps.max(axis=1, initial=0) < self.limits.match_max) & (gaps.mean(axis=1) < self.limits.match_mean)).any()) if len(gaps) else False
