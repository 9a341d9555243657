"""Scalar functions F1-F34 of the inventory, as Column expressions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of pieces by letter, and the logistic slope of win probability.
PIECES = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}
WIN_SLOPE = 0.00368208
MATE_SCORE, MATE_VIEW = 10_000, 15_000


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*\d+\s*$"), F.trim(c).try_cast("int"))


def reading_seconds(c: Column) -> Column:
    """``h:mm:ss`` or ``m:ss`` (colons or dots) to seconds; anything else is null."""
    parts = F.split(F.trim(c), r"[:.]")
    at = [_int(F.get(parts, F.lit(i))) for i in range(3)]
    return F.when(F.size(parts) == 3, at[0] * 3600 + at[1] * 60 + at[2]).when(F.size(parts) == 2, at[0] * 60 + at[1])


def normal_reading(c: Column) -> Column:
    """a reading as ``h:mm:ss`` with any fraction; runs of colons count once, seconds of 60 or more
    give null, minutes roll over into hours."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[^\d.:]", ""), ":+", ":")
    plain = F.regexp_replace(plain, "^:|:$", "")
    parts = F.split(plain, ":")
    n = F.size(parts)
    s = F.element_at(parts, -1).try_cast("double")
    m = F.when(n > 1, F.try_element_at(parts, F.lit(-2)).try_cast("int")).otherwise(0)
    h = F.when(n > 2, F.try_element_at(parts, F.lit(-3)).try_cast("int")).otherwise(0)
    minutes = h * 60 + m
    fraction = F.regexp_extract(plain, r"(\.\d+)$", 1)
    text = F.format_string("%d:%02d:%02d%s", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"), F.floor(s).cast("int"), fraction)
    return F.when((n <= 3) & (plain != "") & (s < 60) & minutes.isNotNull(), text)


def pad_reading(c: Column) -> Column:
    """a short reading with hour and minutes before it, ``0:00:00`` for an empty one."""
    colons = F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit("")))
    whole = F.length(F.substring_index(c, ".", 1))
    return (F.when(c.isNull() | (c == ""), "0:00:00")
            .when(colons == 0, F.concat(F.when(whole == 1, "0:00:0").otherwise("0:00:"), c))
            .when(colons == 1, F.concat(F.when(F.instr(c, ":") == 2, "0:0").otherwise("0:"), c)).otherwise(c))


def recover_suffix(c: Column) -> Column:
    """``1:1x:ss``, a smeared low reading, as ``x:ss``; null for others."""
    found = r"^1[:.]1(\d)[:.](\d\d)$"
    return F.when(c.rlike(found), F.concat(F.regexp_extract(c, found, 1), F.lit(":"), F.regexp_extract(c, found, 2)))


def choose_reading(candidates: Column, current: Column, previous: Column, low: int = 120, slack: int = 65) -> Column:
    """the reading to take among candidates, given the present one and the previous of the same side.

    A plausible present reading stays, but in low time a candidate at most five seconds above it wins. An
    unreadable or implausible one gives way: in low time to the greatest plausible candidate below ``low``,
    else to the plausible one nearest to the previous. Ties go to the candidate that sorts first.
    """
    was, now = reading_seconds(previous), reading_seconds(current)
    timed = F.transform(candidates, lambda r: F.struct(reading_seconds(r).alias("s"), r.alias("r")))
    fit = F.filter(timed, lambda x: x["s"].isNotNull() & (x["s"] <= was + slack))

    def least(rows: Column, key: object) -> Column:
        return F.get(F.array_sort(F.transform(rows, lambda x: F.struct(key(x).alias("k"), x["r"].alias("r")))), F.lit(0))["r"]

    sound = F.coalesce(now <= was + slack, F.lit(False))
    near_above = least(F.filter(fit, lambda x: (x["s"] > now) & (x["s"] - now <= 5)), lambda x: -x["s"])
    low_best = least(F.filter(fit, lambda x: x["s"] < low), lambda x: -x["s"])
    nearest = least(fit, lambda x: F.abs(x["s"] - was))
    short = F.length(F.coalesce(current, F.lit(""))) - F.length(F.replace(F.coalesce(current, F.lit("")), F.lit(":"), F.lit(""))) < 2
    return (F.when(was.isNull() | (F.size(candidates) <= 0), current)
            .when(sound & (now > was) & (now < low), F.coalesce(near_above, current)).when(sound, current)
            .when((was < low) & short & low_best.isNotNull(), low_best).otherwise(F.coalesce(nearest, current)))


def cue_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def move_number(state: Column) -> Column:
    """``n.`` before a move of the first side, ``n...`` before one of the second, by the state's side to move."""
    return F.when(side_to_move(state) == "b", F.format_string("%d...", full_move(state))).otherwise(F.format_string("%d.", full_move(state)))


def state_key(state: Column) -> Column:
    """F8: the first four fields of a state."""
    return F.substring_index(F.trim(state), " ", 4)


def side_to_move(state: Column) -> Column:
    return F.get(F.split(F.trim(state), " +"), F.lit(1))


def full_move(state: Column) -> Column:
    """the full-move number; 1 where a state has none."""
    return F.coalesce(F.get(F.split(F.trim(state), " +"), F.lit(5)).try_cast("int"), F.lit(1))


def seq_of_state(state: Column) -> Column:
    """how many transitions came before a state."""
    return (full_move(state) - 1) * 2 + F.when(side_to_move(state) == "b", 1).otherwise(0)


def expand_cells(state: Column) -> Column:
    """the placement field as an array of 64 cells, '.' for an empty one."""
    text = F.replace(F.substring_index(state, " ", 1), F.lit("/"), F.lit(""))
    for n in range(1, 9):
        text = F.replace(text, F.lit(str(n)), F.lit("." * n))
    return F.split(text, "")


def occupied_cells(state: Column) -> Column:
    """F11."""
    return F.length(F.regexp_replace(F.substring_index(state, " ", 1), r"[\d/]", ""))


def material(state: Column) -> Column:
    """weighted pieces of the first side (capitals) less those of the second."""
    text = F.substring_index(state, " ", 1)
    total = F.lit(0)
    for piece, weight in PIECES.items():
        for letter, sign in ((piece.upper(), weight), (piece, -weight)):
            total = total + (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))) * sign
    return total


def evaluation_text(cp: Column, mate: Column, flip: Column) -> Column:
    """``+0.35`` or ``+M3``, seen from the other side where ``flip`` is true."""
    sign = F.when(flip, -1).otherwise(1)
    m, v = mate * sign, cp * sign / 100.0
    return F.when(mate.isNotNull(), F.concat(F.when(m > 0, "+M").otherwise("-M"), F.abs(m).cast("string"))).when(
        cp.isNotNull(), F.format_string("%+.2f", v))


def line_score(cp: Column, mate: Column) -> Column:
    """centipawns, a mate in n counting 10000 - n for its side."""
    return F.when(mate.isNull(), cp).when(mate > 0, MATE_SCORE - mate).otherwise(-MATE_SCORE - mate)


def white_view(cp: Column, mate: Column, state: Column) -> Column:
    """the score from the first side's view; a mate counts 15000."""
    own = F.when(mate.isNull(), cp).when(mate > 0, MATE_VIEW).otherwise(-MATE_VIEW)
    return F.when(side_to_move(state) == "b", -own).otherwise(own)


def win_probability(cp: Column) -> Column:
    """F16."""
    return 1 / (1 + F.exp(-WIN_SLOPE * cp))


def score_confidence(score: Column) -> Column:
    """per cent; 0 to 25 rises to 50, 25 to 60 to 99.9."""
    return F.when(score >= 60, 99.9).when(score <= 0, 0.0).when(score >= 25, 50 + (score - 25) / 35 * 49.9).otherwise(score / 25 * 50)


def round_time(seconds: Column) -> Column:
    """to hundredths, half up."""
    return F.floor(seconds * 100 + 0.5) / 100.0


def line_style(rank: Column, gap: Column, base: int = 16) -> Column:
    """(thickness in per cent, opacity) of a line by its rank (from 0) and its gap in centipawns."""
    lead = (rank == 0) | (gap <= 10)
    close = 1 - F.least(F.greatest((gap - 10) / 170.0, F.lit(0.0)), F.lit(1.0))
    thick = F.when(lead, base).otherwise(F.least(F.greatest(F.floor(base * (0.42 + 0.58 * close) + 0.5), F.lit(5)), F.lit(base)))
    plain = F.when(lead, 0.48).when(rank == 1, 0.34).when(rank == 2, 0.26).otherwise(0.20)
    far = F.when(gap > 80, 1 - F.least((gap - 80) / 240.0, F.lit(1.0)) * 0.35).otherwise(1.0)
    return F.struct(thick.cast("int").alias("thickness"), F.least(F.greatest(plain * far, F.lit(0.14)), F.lit(0.48)).alias("opacity"))


def split_annotation(c: Column) -> Column:
    """(move, annotation) of a coordinate move with a suffix."""
    at = r"^([a-h1-8qrbn]*)(.*)$"
    return F.struct(F.regexp_extract(c, at, 1).alias("move"), F.regexp_extract(c, at, 2).alias("annotation"))


def first_tokens(c: Column, n: int) -> Column:
    """F21."""
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def digits(c: Column) -> Column:
    """F22."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def metadata_map(c: Column, volatile: tuple[str, ...] = ()) -> Column:
    """``k=v;k=v`` as a map without volatile keys."""
    return F.map_filter(F.str_to_map(c, F.lit(";"), F.lit("=")), lambda k, _: ~k.isin(*volatile) & (k != "") if volatile else k != "")


def content_hash(*c: Column) -> Column:
    """an identity hash; its values are not those of another engine."""
    return F.xxhash64(*c)


def cache_key(*c: Column) -> Column:
    """F25."""
    return F.concat_ws("|", *c)


def uncertainty(confidence: Column) -> Column:
    """1 - c between 0 and 1; 1 where c is missing, negative or not a number."""
    bad = confidence.isNull() | F.isnan(confidence) | (confidence < 0)
    return F.when(bad, 1.0).otherwise(F.least(F.greatest(1.0 - confidence, F.lit(0.0)), F.lit(1.0)))


def pack_id(chunk: Column, index: Column) -> Column:
    """chunk in the upper half, index in the lower."""
    return F.shiftleft(chunk.cast("long"), 32).bitwiseOR(index.cast("long"))


def unpack_id(packed: Column) -> Column:
    return F.struct(F.shiftright(packed, 32).alias("chunk"), packed.bitwiseAND(F.lit(0xFFFFFFFF)).alias("index"))


def quadrants(cells: Column) -> list[Column]:
    """Mean of each quarter of an 8 x 8 grid, row by row."""
    found = []
    for top, left in ((0, 0), (0, 4), (4, 0), (4, 4)):
        total = F.lit(0.0)
        for row in range(4):
            part = F.slice(cells, (top + row) * 8 + left + 1, 4)
            total = total + F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
        found.append(total / 16)
    return found


def bucket_of(mean: Column, width: float = 8.0) -> Column:
    return F.least(F.greatest(F.floor(mean / width + 0.5), F.lit(0)), F.lit(63)).cast("long")


def pack_buckets(b: list[Column]) -> Column:
    """four buckets of six bits."""
    return F.shiftleft(b[0], 18) + F.shiftleft(b[1], 12) + F.shiftleft(b[2], 6) + b[3]


def condition_list(c: Column) -> Column:
    """a condition that is text with commas or a JSON array, as an array of trimmed names."""
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    found = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (F.size(found) == 0), F.array(F.lit("unspecified"))).otherwise(found)


def result_text(winner: Column) -> Column:
    """F31."""
    return F.when(winner == "white", "1-0").when(winner == "black", "0-1").when(winner == "draw", "1/2-1/2").otherwise("*")


def region_bounds(geometry: Column, frame_width: Column, frame_height: Column) -> Column:
    """F32: the readings' regions above and below a board (x, y, width, height, square_height)."""
    low = geometry["y"] + geometry["height"]
    cell = geometry["square_height"]
    top = F.greatest(F.lit(0), (geometry["y"] - cell * 0.55).cast("int"))
    return F.struct(
        F.greatest(F.lit(0), (geometry["x"] + geometry["width"] * 0.70).cast("int")).alias("x1"),
        F.least(frame_width, (geometry["x"] + geometry["width"]).cast("int")).alias("x2"),
        top.alias("top_y1"), F.greatest(top + 1, (geometry["y"] - cell * 0.08).cast("int")).alias("top_y2"),
        F.least(frame_height - 1, (low + cell * 0.18).cast("int")).alias("bottom_y1"),
        F.least(frame_height, (low + cell * 0.58).cast("int")).alias("bottom_y2"))


def distance_max(a: Column, b: Column) -> Column:
    """greatest absolute difference of two vectors; null unless they are of one width."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def distance_mean(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def lower_plausible(a: Column, b: Column, slack: int = 65) -> Column:
    """the lower of two readings in seconds if they are within ``slack``, else the first that is there."""
    return F.when(F.abs(a - b) <= slack, F.least(a, b)).otherwise(F.coalesce(a, b))
