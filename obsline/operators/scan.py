"""Scans along streams in segments, so that one long stream is no single task.

A stream is cut by its first ordering column into segments of bounded size. Each is folded apart; what segments hand on
(their last row, last known value, sum, least value) is one row each, over which a window makes the carries; these go back to the
rows of their segment by a join whose keys are as small as segments. Results are those of windows over whole streams.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

#: Rows to a segment.
ROWS = 100_000
SEGMENT = "_segment"


def segments(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """The rows with their segment, a number that rises with the column: some ``rows`` rows of all streams each.

    Bounds come from a quantile sketch. Nulls are in the first segment, as they sort first. Rows of equal value share a segment, and a
    column that is neither number nor time gives a single one.
    """
    if SEGMENT in df.columns:
        return df
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        value = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    elif isinstance(kind, NumericType):
        value = F.col(column).cast("double")
    else:
        return df.withColumn(SEGMENT, F.lit(0.0))
    parts = -(-df.count() // (rows or ROWS))
    if parts <= 1:
        return df.withColumn(SEGMENT, F.lit(0.0))
    low = float("-inf")
    valued = df.withColumn("_value", F.coalesce(value, F.lit(low)))
    bounds = valued.select("_value").approxQuantile("_value", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    splits = [low, *sorted({x for x in bounds if abs(x) != float("inf")}), float("inf")]
    return Bucketizer(splits=splits, inputCol="_value", outputCol=SEGMENT, handleInvalid="keep").transform(valued).drop("_value")


def scan(df: DataFrame, by: str, order: tuple[str, ...], previous: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
         sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, descending: bool = False, rows: int | None = None) -> DataFrame:
    """New columns along each stream ``by``: ``previous``, an expression at the row before; ``last``, its last known value up to the row;
    ``sums``, its sum up to the row; ``least``, its least value over the rows before. Null streams are one.

    The segments stay in the column SEGMENT, so that several scans of the same order need them once.
    """
    previous, last, sums, least = (x or {} for x in (previous, last, sums, least))
    way = F.desc if descending else F.asc
    cut = segments(df, order[0], rows).withColumns({f"_p_{n}": c for n, c in previous.items()} | {f"_l_{n}": c for n, c in last.items()} | {
        f"_s_{n}": c for n, c in sums.items()} | {f"_m_{n}": c for n, c in least.items()})
    place = F.struct(*order)
    ends = F.min_by if descending else F.max_by
    ahead = [F.struct(*[f"_p_{n}" for n in previous], F.lit(1).alias("_there")).alias("_row")] if previous else []
    cut = cut.select("*", *ahead)
    folded = cut.groupBy(by, SEGMENT).agg(
        F.count("*").alias("_rows"), *([ends("_row", place).alias("_row")] if previous else []),
        *[ends(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in last],
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums], *[F.min(f"_m_{n}").alias(f"_m_{n}") for n in least])
    over = Window.partitionBy(by).orderBy(way(SEGMENT))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carries = folded.select(
        F.col(by).alias("_by"), F.col(SEGMENT).alias("_at"), *([F.lag("_row").over(over).alias("_c_row")] if previous else []),
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in last],
        *[F.sum(f"_s_{n}").over(before).alias(f"_cs_{n}") for n in sums], *[F.min(f"_m_{n}").over(before).alias(f"_cm_{n}") for n in least])
    inside = Window.partitionBy(by, SEGMENT).orderBy(*(way(c) for c in order))
    up_to, above = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumns(
        ({"_o_row": F.lag("_row").over(inside)} if previous else {}) | {f"_ol_{n}": F.last(f"_l_{n}", ignorenulls=True).over(up_to) for n in last}
        | {f"_os_{n}": F.sum(f"_s_{n}").over(up_to) for n in sums} | {f"_om_{n}": F.min(f"_m_{n}").over(above) for n in least})
    joined = own.join(carries, F.col(by).eqNullSafe(F.col("_by")) & (F.col(SEGMENT) == F.col("_at")), "left")
    row = F.coalesce("_o_row", "_c_row") if previous else None
    return joined.select(
        *df.columns, *([] if SEGMENT in df.columns else [SEGMENT]), *[row[f"_p_{n}"].alias(n) for n in previous],
        *[F.coalesce(f"_ol_{n}", f"_cl_{n}").alias(n) for n in last],
        *[F.when(F.coalesce(f"_os_{n}", f"_cs_{n}").isNotNull(), F.coalesce(f"_os_{n}", F.lit(0)) + F.coalesce(f"_cs_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.least(f"_om_{n}", f"_cm_{n}").alias(n) for n in least])
