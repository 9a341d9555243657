"""Branch normalisation J9, J15, J19, J23, U5, U7, A26, A31-A35, as joins over long tables.

timeline: (stream_id, seq, state, move, ts): ``state`` is the one before ``move``.
branches: (stream_id, branch_id, parent_seq, step, state, move, ts, score): steps count from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsline.functions.scalars import state_key

STREAM = "stream_id"
BRANCH = [STREAM, "branch_id"]
#: Places of the main line to a block.
PLACES = 64


def heads(branches: DataFrame) -> DataFrame:
    """One row for each branch: root state, first and last time, steps, greatest score."""
    return branches.groupBy(*BRANCH).agg(
        F.min("parent_seq").alias("parent_seq"), F.min_by("state", "step").alias("root"), F.min_by("ts", "step").alias("start_ts"),
        F.max_by("ts", "step").alias("stop_ts"), F.count("*").alias("steps"), F.max("score").alias("best_score"))


def exact_replay_filter(branches: DataFrame, timeline: DataFrame, seconds: float = 0.05) -> DataFrame:
    """Drop branches that repeat a run of the main line from the same root, seen later than it.

    A branch meets the main line once at each main-line place of its root; it is a replay where as many
    steps agree there as it has.
    """
    main = timeline.select(STREAM, F.col("seq").alias("m_seq"), F.col("state").alias("m_state"), F.col("move").alias("m_move"), F.col("ts").alias("m_ts"))
    top = heads(branches)
    places = top.join(main, (top[STREAM] == main[STREAM]) & (top["root"] == main["m_state"])).select(
        top[STREAM], "branch_id", F.col("m_seq").alias("at"), "steps", "start_ts", F.col("m_ts").alias("root_ts"))
    steps = branches.select(*BRANCH, "step", "state", "move").join(places, BRANCH).withColumn("m_seq", F.col("at") + F.col("step"))
    agree = steps.join(main, [STREAM, "m_seq"]).filter("state = m_state AND move = m_move").groupBy(*BRANCH, "at").agg(
        F.count("*").alias("n"), F.first("steps").alias("steps"), F.first("start_ts").alias("start_ts"), F.first("root_ts").alias("root_ts"))
    replays = agree.filter((F.col("n") == F.col("steps")) & (F.unix_micros("start_ts") > F.unix_micros("root_ts") + int(seconds * 1e6)))
    return branches.join(replays.select(*BRANCH).distinct(), BRANCH, "left_anti")


def known_root_filter(branches: DataFrame, timeline: DataFrame, seconds: float = 60) -> DataFrame:
    """Drop one-step branches whose root the main line lacks and that start over ``seconds`` after their parent."""
    top = heads(branches).filter("steps = 1").withColumn("key", state_key(F.col("root")))
    lost = top.join(timeline.select(STREAM, state_key(F.col("state")).alias("key")).distinct(), [STREAM, "key"], "left_anti")
    parents = timeline.select(STREAM, F.col("seq").alias("parent_seq"), F.col("ts").alias("parent_ts"))
    late = lost.join(parents, [STREAM, "parent_seq"], "left").filter(
        F.unix_micros("start_ts") > F.coalesce(F.unix_micros("parent_ts"), F.lit(0)) + int(seconds * 1e6))
    return branches.join(late.select(*BRANCH), BRANCH, "left_anti")


def _chains(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(stream_id, branch_id, into, shift, rank): the head of each link's chain, the way and the number of links to it.

    Links (stream_id, branch_id, into, shift) have no ring, and no branch has two. Pointers double: a chain of n links takes log n rounds.
    """
    links = links.select(*BRANCH, "into", F.col("shift").cast("long").alias("shift"), F.lit(1).cast("long").alias("rank"))
    for _ in range(rounds):
        up = links.select(STREAM, F.col("branch_id").alias("into"), F.col("into").alias("into2"), F.col("shift").alias("shift2"), F.col("rank").alias("rank2"))
        further = links.join(up, [STREAM, "into"], "left").select(
            *BRANCH, F.coalesce("into2", "into").alias("into"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"),
            (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank"), F.col("into2").isNotNull().alias("moved")).checkpoint()
        links = further.drop("moved")
        if further.filter("moved").isEmpty():
            return links
    raise RuntimeError("branches still change")


def _interior_links(current: DataFrame, turn: int) -> DataFrame:
    """Links (stream_id, branch_id, into, shift) without rings: a branch has at most one, and at most one leads into it.

    A branch asks one of those that fit it, and these take one of those that ask. They meet by stream, root and a shared move, and in large
    groups in drawn buckets of some two, so that no group makes pairs; who finds none in its bucket asks the group's first or last. The
    first turn prefers least ids, later ones draw lots, so that of many branches with one root a fixed share joins in each turn.
    """
    def lot(name: str):
        return F.lit(0).cast("long") if turn == 0 else F.xxhash64(F.lit(turn), F.col(name))

    key = [STREAM, "root", "move"]
    top = current.groupBy(*BRANCH).agg(F.min_by("state", "step").alias("root"))
    last = current.filter("move IS NOT NULL").groupBy(*BRANCH, "move").agg(F.max("step").alias("last"))
    asks = top.join(last, BRANCH).select(*key, F.col("branch_id").alias("inner"))
    roots = top.select(STREAM, F.col("root").alias("state")).distinct()
    cuts = current.filter("step > 0").join(roots, [STREAM, "state"], "left_semi").groupBy(*BRANCH, F.col("state").alias("root")).agg(F.min("step").alias("cut"))
    offers = cuts.join(last, BRANCH).filter("last >= cut").select(*key, F.struct(lot("branch_id").alias("lot"), F.col("branch_id").alias("outer"), "cut").alias("offer")).checkpoint()
    groups = offers.groupBy(*key).agg(F.count("*").alias("n"), F.min("offer").alias("first"), F.max("offer").alias("last"))

    def bucket(name: str):
        return F.pmod(F.xxhash64(F.lit("bucket"), F.lit(turn), F.col(name)), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))

    near = offers.join(groups.select(*key, "n"), key).groupBy(*key, bucket("offer.outer").alias("bucket")).agg(F.min("offer").alias("low"), F.max("offer").alias("high"))
    found = asks.join(groups, key).withColumn("bucket", bucket("inner")).join(near, [*key, "bucket"], "left")
    other = [F.when(F.col(f"{c}.outer") != F.col("inner"), F.col(c)) for c in ("low", "high", "first", "last")]
    chosen = found.withColumn("offer", F.coalesce(*other)).filter("offer IS NOT NULL").groupBy(STREAM, "inner").agg(
        F.min(F.struct(F.coalesce(other[0], other[1]).isNull().alias("far"), "offer")).alias("x")).select(STREAM, "inner", "x.offer.*")
    links = chosen.groupBy(STREAM, F.col("outer").alias("into")).agg(F.min(F.struct(lot("inner").alias("lot"), F.col("inner").alias("branch_id"), F.col("cut").alias("shift"))).alias("x")).select(
        STREAM, "x.branch_id", "into", "x.shift").checkpoint()
    # Every ring has a branch whose id is less than both its neighbours'; such links go, wherever they are.
    child = links.select(STREAM, F.col("into").alias("branch_id"), F.col("branch_id").alias("child"))
    return links.join(child, BRANCH, "left").filter("child IS NULL OR branch_id > into OR branch_id > child").drop("child").checkpoint()


def _unclean(current: DataFrame, links: DataFrame, chains: DataFrame) -> DataFrame:
    """Branches whose root already lies, past its first step, in what their chain keeps before the place where they would go."""
    stops = links.select(STREAM, F.col("into").alias("branch_id"), F.col("shift").alias("stop"))
    long = chains.filter("rank > 1").select(STREAM, "into").distinct()
    placed = current.select(*BRANCH, "step", "state").join(stops, BRANCH, "left").filter("stop IS NULL OR step < stop").join(chains, BRANCH, "left").select(
        STREAM, F.coalesce("into", "branch_id").alias("into"), "state", (F.col("step") + F.coalesce("shift", F.lit(0))).alias("place"))
    first = placed.filter("place > 0").join(long, [STREAM, "into"], "left_semi").groupBy(STREAM, "into", "state").agg(F.min("place").alias("first"))
    roots = current.groupBy(*BRANCH).agg(F.min_by("state", "step").alias("state"))
    return chains.filter("rank > 1").join(roots, BRANCH).join(first, [STREAM, "into", "state"]).filter("first < shift").select(*BRANCH).checkpoint()


def join_interiors(branches: DataFrame) -> DataFrame:
    """J15, interior form: a branch whose root is a state inside another (its first such step from 1 on), and which has one of
    the moves that follow there, replaces the other's rest from that step; until no branch fits another.

    In each turn a branch goes into one other and takes one in. Chains of such joins are made at once, as if the outermost took the others
    in one after another; where one would then go to an earlier place of its chain, the chain breaks, and of what is left there every second
    link is joined alone. So n branches in a chain, or with one root, take log n turns, each written to the checkpoint folder, and no
    branches meet in pairs: a branch of k steps that are roots and m different moves costs k m rows. States are compared whole, as in exact
    replays; null states and moves fit nothing. What joins first decides where several orders end differently; ids and states alone
    decide that here, not partitions.
    """
    current, turn = branches.checkpoint(), 0
    while True:
        links = _interior_links(current, turn)
        if links.isEmpty():
            return current
        chains = _chains(links)
        bad = None if chains.filter("rank > 1").isEmpty() else _unclean(current, links, chains)
        if bad is not None and not bad.isEmpty():
            marked = links.join(chains.select(*BRANCH, "rank"), BRANCH).join(bad.withColumn("bad", F.lit(True)), BRANCH, "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
            above = marked.select(STREAM, F.col("branch_id").alias("into"), F.col("bad").alias("above"))
            below = marked.select(STREAM, F.col("into").alias("branch_id"), F.col("bad").alias("below"))
            alone = (F.col("rank") % 2 == 1) & F.coalesce("above", F.lit(True)) & F.coalesce("below", F.lit(True))
            links = marked.join(above, [STREAM, "into"], "left").join(below, BRANCH, "left").filter(~F.col("bad") | alone).select(*BRANCH, "into", "shift").checkpoint()
            chains = _chains(links)
        stops = links.select(STREAM, F.col("into").alias("branch_id"), F.col("shift").alias("stop"))
        parents = current.groupBy(STREAM, F.col("branch_id").alias("into")).agg(F.min("parent_seq").alias("into_parent"))
        moved = chains.drop("rank").join(parents, [STREAM, "into"])
        current = current.join(stops, BRANCH, "left").filter("stop IS NULL OR step < stop").join(moved, BRANCH, "left").select(
            STREAM, F.coalesce("into", "branch_id").alias("branch_id"), F.coalesce("into_parent", "parent_seq").alias("parent_seq"), (F.col("step") + F.coalesce("shift", F.lit(0))).alias("step"),
            *[c for c in branches.columns if c not in (*BRANCH, "parent_seq", "step")]).checkpoint()
        turn += 1


def join_continuations(branches: DataFrame, seconds: float = 0.05, rounds: int = 64) -> DataFrame:
    """Append a branch to the one at whose end its root is, if it starts later; until nothing changes.

    join_interiors is the form for roots inside another branch. Works on one row for each branch: each continuation takes the earliest such end, and chains are
    shortened by doubling, so that a chain of n links takes log n rounds. The steps move once, at the end.
    """
    top = heads(branches)
    last = branches.groupBy(*BRANCH).agg(F.max_by("next_state", "step").alias("end"))
    ends = top.join(last, BRANCH).select(STREAM, F.col("branch_id").alias("into"), state_key(F.col("end")).alias("key"), F.col("stop_ts").alias("end_ts"))
    roots = top.select(STREAM, "branch_id", state_key(F.col("root")).alias("key"), "start_ts")
    fit = roots.join(ends, [STREAM, "key"]).filter(
        (F.col("branch_id") != F.col("into")) & (F.unix_micros("start_ts") > F.unix_micros("end_ts") + int(seconds * 1e6)))
    # Each branch continues one other, and is continued by one other.
    one = fit.withColumn("a", F.row_number().over(Window.partitionBy(STREAM, "branch_id").orderBy("end_ts", "into"))).filter("a = 1")
    one = one.withColumn("b", F.row_number().over(Window.partitionBy(STREAM, "into").orderBy("start_ts", "branch_id"))).filter("b = 1")
    sizes = top.select(STREAM, "branch_id", "steps")
    links = _chains(one.select(STREAM, "branch_id", "into").join(sizes.select(STREAM, F.col("branch_id").alias("into"), F.col("steps").alias("shift")), [STREAM, "into"]), rounds)
    parents = top.select(STREAM, F.col("branch_id").alias("into"), F.col("parent_seq").alias("into_parent"))
    moved = links.drop("rank").join(parents, [STREAM, "into"])  # starts lie strictly after ends, so there is no ring
    return branches.join(moved, BRANCH, "left").select(
        STREAM, F.coalesce("into", "branch_id").alias("branch_id"), F.coalesce("into_parent", "parent_seq").alias("parent_seq"),
        (F.col("step") + F.coalesce("shift", F.lit(0))).alias("step"), *[c for c in branches.columns if c not in (*BRANCH, "parent_seq", "step")])


def reanchor_branches(branches: DataFrame, timeline: DataFrame) -> DataFrame:
    """Each branch to the main-line state equal to its root that is nearest to its parent, else dropped."""
    top = heads(branches).withColumn("key", state_key(F.col("root")))
    places = timeline.select(STREAM, state_key(F.col("state")).alias("key"), F.col("seq").alias("at"))
    w = Window.partitionBy(*BRANCH).orderBy(F.abs(F.col("at") - F.col("parent_seq")), "at")
    best = top.join(places, [STREAM, "key"]).withColumn("n", F.row_number().over(w)).filter("n = 1").select(*BRANCH, "at")
    return branches.join(best, BRANCH).withColumn("parent_seq", F.col("at")).drop("at")


def flatten_orphan_forks(branches: DataFrame, timeline: DataFrame) -> DataFrame:
    """A branch whose parent lies beyond the main line goes under the branch that holds its root inside.

    Adds ``under`` (the branch, null for the main line) and ``under_step``; still out of range is dropped.
    """
    length = timeline.groupBy(STREAM).agg(F.max("seq").alias("last"))
    top = heads(branches).join(length, STREAM, "left").withColumn("beyond", F.col("parent_seq") > F.coalesce("last", F.lit(-1)))
    inside = branches.select(STREAM, F.col("branch_id").alias("under"), F.col("step").alias("under_step"), state_key(F.col("state")).alias("key"))
    lost = top.filter("beyond").select(*BRANCH, state_key(F.col("root")).alias("key"))
    w = Window.partitionBy(*BRANCH).orderBy("under", "under_step")
    homes = lost.join(inside, [STREAM, "key"]).filter("under <> branch_id AND under_step > 0").withColumn("n", F.row_number().over(w)).filter("n = 1")
    placed = top.select(*BRANCH, "beyond").join(homes.select(*BRANCH, "under", "under_step"), BRANCH, "left").filter("NOT beyond OR under IS NOT NULL")
    return branches.join(placed.select(*BRANCH, "under", "under_step"), BRANCH)


def prefix_supersede(branches: DataFrame) -> DataFrame:
    """Drop a branch that is a prefix of a sibling, or that a branch covers at a later offset.

    Branches meet where the covering one has, at the fitting step, the covered one's first move; a branch
    is covered where all its steps agree. Of equal ones the least id stays.
    """
    steps = branches.select(*BRANCH, "parent_seq", "step", "move")
    first = steps.filter("step = 0").select(STREAM, F.col("branch_id").alias("small"), F.col("parent_seq").alias("small_parent"), "move")
    starts = steps.withColumn("place", F.col("parent_seq") + F.col("step")).select(STREAM, F.col("branch_id").alias("big"), F.col("parent_seq").alias("big_parent"), "place", "move")
    meet = first.join(starts, (first[STREAM] == starts[STREAM]) & (first["move"] == starts["move"]) & (first["small_parent"] == starts["place"])).filter(
        "small <> big").select(first[STREAM], "small", "small_parent", "big", "big_parent")
    small = steps.select(STREAM, F.col("branch_id").alias("small"), F.col("step").alias("s_step"), F.col("move").alias("s_move"))
    big = steps.select(STREAM, F.col("branch_id").alias("big"), F.col("step").alias("b_step"), F.col("move").alias("b_move"))
    pairs = meet.join(small, [STREAM, "small"]).withColumn("b_step", F.col("s_step") + F.col("small_parent") - F.col("big_parent")).join(
        big, [STREAM, "big", "b_step"], "left")
    whole = pairs.groupBy(STREAM, "small", "big").agg(F.bool_and(F.coalesce(F.col("s_move") == F.col("b_move"), F.lit(False))).alias("all"), F.count("*").alias("n"))
    sizes = steps.groupBy(*BRANCH).agg(F.count("*").alias("big_n"), F.min("parent_seq").alias("p")).withColumnRenamed("branch_id", "big")
    tops = steps.groupBy(*BRANCH).agg(F.min("parent_seq").alias("sp")).withColumnRenamed("branch_id", "small")
    covered = whole.filter("all").join(sizes, [STREAM, "big"]).join(tops, [STREAM, "small"]).filter(
        (F.col("p") != F.col("sp")) | (F.col("n") < F.col("big_n")) | (F.col("big") < F.col("small")))
    return branches.join(covered.select(STREAM, F.col("small").alias("branch_id")).distinct(), BRANCH, "left_anti")


def trim_shared_prefix(branches: DataFrame, timeline: DataFrame) -> DataFrame:
    """Cut the steps a branch shares with the main line from its parent on, and move its parent; all shared drops it."""
    main = timeline.select(STREAM, F.col("seq").alias("place"), F.col("move").alias("m_move"))
    both = branches.withColumn("place", F.col("parent_seq") + F.col("step")).join(main, [STREAM, "place"], "left")
    cut = both.groupBy(*BRANCH).agg(F.min(F.when(~F.col("move").eqNullSafe(F.col("m_move")), F.col("step"))).alias("cut")).filter("cut IS NOT NULL")
    return branches.join(cut, BRANCH).filter("step >= cut").withColumn("parent_seq", F.col("parent_seq") + F.col("cut")).withColumn(
        "step", F.col("step") - F.col("cut")).drop("cut")


def move_budget(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """The first k occurrences of a transition stay what they are, the others are rollbacks."""
    w = Window.partitionBy(STREAM, "move").orderBy("ts", "seq")
    return rows.join(budget, [STREAM, "move"], "left").withColumn("kind", F.when(F.row_number().over(w) <= F.coalesce("k", F.lit(0)), "transition").otherwise("rollback")).drop("k")


def _common(own: list[str], line: list[str]) -> int:
    """Length of the longest common subsequence. A bit stands for a move of ``own``; a machine word does 64 of them at once.

    After each move of the line, a bit that is 0 says that the subsequence is one longer from its move on.
    """
    places: dict[str, int] = {}
    for i, move in enumerate(own):
        places[move] = places.get(move, 0) | 1 << i
    every = (1 << len(own)) - 1
    flat = every
    for move in line:
        hit = flat & places.get(move, 0)
        flat = ((flat + hit) | (flat - hit)) & every
    return len(own) - flat.bit_count()


def lcs_replay_test(branches: DataFrame, timeline: DataFrame, least: int = 8, extra: int = 8, share: float = 0.8) -> DataFrame:
    """(stream_id, branch_id, steps, matches, replay): ordered overlap with the main line from the parent on.

    A branch meets the blocks of PLACES places of the main line that it may overlap: from its parent, as many places as it has steps
    and ``extra`` more. Both sides are arrays of one row then.
    """
    arrays = branches.groupBy(*BRANCH).agg(F.min("parent_seq").alias("parent_seq"), F.transform(F.array_sort(F.collect_list(F.struct("step", "move"))), lambda x: x["move"]).alias("own"))
    block = F.floor(F.col("seq") / PLACES)
    main = timeline.select(STREAM, "seq", F.col("move").alias("m_move"), block.alias("block"))
    until = F.col("parent_seq") + F.size("own") + extra
    asked = arrays.select(*BRANCH, "parent_seq", until.alias("until")).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("parent_seq") / PLACES), F.floor((F.col("until") - 1) / PLACES))))
    near = asked.join(main, [STREAM, "block"]).filter((F.col("seq") >= F.col("parent_seq")) & (F.col("seq") < F.col("until")))
    line = near.groupBy(*BRANCH).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "m_move"))), lambda x: x["m_move"]).alias("line"))
    rows = arrays.join(line, BRANCH, "left").select(*BRANCH, "own", F.coalesce("line", F.array().cast("array<string>")).alias("line"))

    def overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matches = [_common(list(own), list(line)) for own, line in zip(pdf["own"], pdf["line"], strict=True)]
            yield pdf[BRANCH].assign(steps=pdf["own"].map(len), matches=matches)

    kinds = {f.name: f.dataType.simpleString() for f in branches.schema}
    found = rows.mapInPandas(overlap, f"stream_id {kinds[STREAM]}, branch_id {kinds['branch_id']}, steps long, matches long")
    return found.withColumn("replay", (F.col("steps") >= least) & (F.col("matches") >= share * F.col("steps")))


def weak_branch_filter(branches: DataFrame, least: float = 60) -> DataFrame:
    """Drop branches of several steps none of which scores ``least``."""
    weak = heads(branches).filter((F.col("steps") > 1) & ~F.coalesce(F.col("best_score") >= least, F.lit(False)))
    return branches.join(weak.select(*BRANCH), BRANCH, "left_anti")


def stable_single_step(branches: DataFrame, least: float = 57, seconds: float = 0.75) -> DataFrame:
    """Of one-step branches those with a score of ``least`` that lived ``seconds`` (column lifetime) stay."""
    top = branches.groupBy(*BRANCH).agg(F.count("*").alias("n"), F.max("score").alias("s"), F.max("lifetime").alias("l"))
    return branches.join(top.filter((F.col("n") > 1) | ((F.col("s") >= least) & (F.col("l") >= seconds))).select(*BRANCH), BRANCH, "left_semi")


def postgame_replay_filter(branches: DataFrame, timeline: DataFrame, seconds: float = 1) -> DataFrame:
    """Drop replay branches that start over ``seconds`` after the main line's end and root inside it."""
    ends = timeline.groupBy(STREAM).agg(F.max("ts").alias("end_ts"), F.max("seq").alias("last"))
    replays = branches.filter("replay").groupBy(*BRANCH).agg(F.min("ts").alias("start_ts"), F.min("parent_seq").alias("parent_seq"))
    drop = replays.join(ends, STREAM).filter((F.unix_micros("start_ts") > F.unix_micros("end_ts") + int(seconds * 1e6)) & (F.col("parent_seq") <= F.col("last")))
    return branches.join(drop.select(*BRANCH), BRANCH, "left_anti")


def clear_unread_branch_readings(branches: DataFrame) -> DataFrame:
    """A missing first reading clears a branch's readings; a last one at a terminal state that repeats the
    same side's one before is dropped."""
    w = Window.partitionBy(*BRANCH).orderBy("step")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unread = F.first("reading").over(whole).isNull()
    stale = F.col("terminal") & F.lead("step").over(w).isNull() & (F.col("reading") == F.lag("reading", 2).over(w))
    return branches.withColumn("reading", F.when(~unread & ~F.coalesce(stale, F.lit(False)), F.col("reading")))
