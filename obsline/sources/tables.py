"""Sources and sinks S1-S16. Readers take explicit schemas and keep what they cannot read apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsline.functions.scalars import cue_time

EVENT_SCHEMA = (
    "schema_version INT, sequence LONG, observation_id LONG, candidate_id LONG, transition_id LONG, state_generation LONG, revert_generation LONG, "
    "branch_id LONG, timestamp DOUBLE, active_ply LONG, event STRING, phase STRING, outcome STRING, reason STRING, reducer_state STRING, fen STRING, "
    "best_move STRING, best_score DOUBLE, max_square_diff DOUBLE, from_yellowness DOUBLE, to_yellowness DOUBLE, metadata STRING, "
    "evidence STRUCT<changed_square_count: LONG, changed_squares: ARRAY<STRUCT<square: STRING, score: DOUBLE, rank: INT>>, yellow_checked: BOOLEAN, "
    "yellow_decision: STRING, yellow_temporal_checked: BOOLEAN, clock_checked: BOOLEAN, clock_decision: STRING, hover_checked: BOOLEAN, "
    "hover_decision: STRING, settle_decision: STRING>, _corrupt STRING")
OBSERVATION_SCHEMA = (
    "stream_id LONG, observation_id LONG, chunk INT, source_index LONG, timestamp DOUBLE, emission_reason STRING, cells ARRAY<DOUBLE>, marks ARRAY<STRING>, _corrupt STRING")
LABEL_SCHEMA = (
    "image STRING, detector STRING, component STRING, truth STRING, prediction STRING, case STRING, source_type STRING, condition STRING, conditions STRING, "
    "regime STRING, transition_id STRING, expected_active STRING, expected_white STRING, expected_black STRING, expected_move STRING, observed_move STRING, "
    "selected_reading STRING, phase STRING, preprocessing_variant STRING, roi_variant STRING, confidence DOUBLE, score DOUBLE, origin_score DOUBLE, "
    "destination_score DOUBLE, pair_score DOUBLE, settle_delay_seconds DOUBLE, premature_settle BOOLEAN, _corrupt STRING")


def _jsonl(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines). Blank lines are skipped; what is no object of the schema is kept as text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    record = F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("value", F.col("_metadata.file_path").alias("file"), record.alias("r"))
    sound = F.trim("value").startswith("{") & F.col("r._corrupt").isNull()
    return parsed.filter(sound).select("r.*", "file").drop("_corrupt"), parsed.filter(~F.coalesce(sound, F.lit(False))).select("file", F.col("value").alias("line"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of malformed lines, for traces of a size that one task can read."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).filter(F.trim("line") != "")
    return lines.filter(~F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))).select((F.col("at") + 1).alias("line_number"))


def write_events(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One object a line, or Parquet."""
    df.write.mode("error").format(fmt).save(path)


TRACE_COLUMNS = ["timestamp", "event", "active_ply", "best_move", "best_score", "max_square_diff", "from_yellowness", "to_yellowness", "fen", "metadata"]


def write_trace_tsv(df: DataFrame, path: str, start: float | None = None, stop: float | None = None) -> None:
    """S3: the bounded ten-column trace, numbers with three decimals."""
    from pyspark.sql.types import DoubleType

    if start is not None and stop is not None:
        df = bounded_window(df, "timestamp", start, stop)
    cols = [F.format_string("%.3f", c).alias(c) if isinstance(df.schema[c].dataType, DoubleType) else F.col(c) for c in TRACE_COLUMNS]
    df.select(*cols).write.mode("error").option("sep", "\t").option("header", True).csv(path)


def read_trace_tsv(spark: SparkSession, path: str) -> DataFrame:
    schema = "timestamp DOUBLE, event STRING, active_ply LONG, best_move STRING, best_score DOUBLE, max_square_diff DOUBLE, from_yellowness DOUBLE, to_yellowness DOUBLE, fen STRING, metadata STRING"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def bounded_window(df: DataFrame, ts: str, start, stop) -> DataFrame:
    """Rows between two times; the filter reaches a Parquet scan."""
    return df.filter(F.col(ts).between(start, stop))


def normal_observations(raw: DataFrame, chunk_seconds: float = 60, chunks: int = 1 << 20, cells: int = 64) -> DataFrame:
    """Defaults and fallbacks; rows without all cells go to the column ``quarantine``."""
    chunk = F.coalesce("chunk", F.least(F.greatest(F.floor(F.col("timestamp") / chunk_seconds), F.lit(0)), F.lit(chunks - 1)).cast("int"))
    index = F.coalesce("source_index", F.round(F.col("timestamp") * 1000).cast("long"))
    return raw.select(
        F.coalesce("stream_id", F.lit(0)).alias("stream_id"), F.coalesce("observation_id", F.shiftleft(chunk.cast("long"), 32) + index).alias("observation_id"),
        chunk.alias("chunk"), index.alias("source_index"), F.coalesce("emission_reason", F.lit("replay")).alias("reason"),
        F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long")).alias("ts"), "cells", F.coalesce("marks", F.array().cast("array<string>")).alias("marks"),
        F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("timestamp").isNull(), "no_time").when(
            F.coalesce(F.size("cells"), F.lit(-1)) != cells, "cells").alias("quarantine"))


def read_observations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """S4, batch or stream."""
    return normal_observations(_jsonl(spark, path, OBSERVATION_SCHEMA, stream))


def write_compact_observations(compact: DataFrame, path: str) -> None:
    """Compacted observations in order within each stream."""
    compact.repartition("stream_id").sortWithinPartitions("stream_id", "observation_key").write.mode("error").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows with detector, truth and prediction. Every other numeric field of a row, whatever its name, is in the map
    ``measures``, and the whole row in the variant ``record``.
    """
    known = [f.strip().split(" ")[0] for f in LABEL_SCHEMA.split(",")]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).withColumn("row", F.from_json("value", LABEL_SCHEMA, options))
    rows = lines.filter("row._corrupt IS NULL AND row.detector IS NOT NULL AND row.truth IS NOT NULL AND row.prediction IS NOT NULL")
    fields = F.from_json("value", "map<string,variant>")
    numbers = F.map_filter(fields, lambda k, v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & ~k.isin("confidence", "score"))
    return rows.select(*[F.col(f"row.{f}").alias(f) for f in known if f != "_corrupt"], F.transform_values(numbers, lambda _, v: F.try_variant_get(v, "$", "double")).alias("measures"),
                       F.parse_json("value").alias("record"))


TOKEN = r"(\{[^}]*\}|\(|\)|\[[^\]]*\]|[^\s()\{\}\[\]]+)"


def game_tokens(texts: DataFrame) -> DataFrame:
    """Tokens (stream_id, pos, token, depth) of game texts, comments whole, depth by parentheses."""
    body = F.regexp_replace("value", r"(?m)^\[[^\n]*\]\s*$", "")
    tokens = texts.select("stream_id", F.posexplode(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(1))).alias("pos", "token"))
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    run = Window.partitionBy("stream_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("depth", F.sum(step).over(run))


def game_tags(texts: DataFrame) -> DataFrame:
    """Header tags (stream_id, key, value)."""
    pairs = F.explode(F.regexp_extract_all("value", F.lit(r'(?m)^(\[\w+\s+"[^"]*"\])'), F.lit(1)))
    return texts.select("stream_id", pairs.alias("tag")).select(
        "stream_id", F.regexp_extract("tag", r"^\[(\w+)", 1).alias("key"), F.regexp_extract("tag", r'"([^"]*)"', 1).alias("value"))


def game_readings(tokens: DataFrame) -> DataFrame:
    """Readings in comments, with their place and depth."""
    return tokens.withColumn("reading", F.regexp_extract("token", r"\[%clk ([\d:.]+)\]", 1)).filter("reading <> ''").select("stream_id", "pos", "depth", "reading")


def read_pgn_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One text a file, with the file as stream."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("stream_id"), "value")


def normalize_lookup_response(bodies: DataFrame) -> DataFrame:
    """Of a body with an object or one a line, the last useful one; a missing name comes from an earlier line."""
    parsed = F.from_json("line", "opening STRUCT<eco: STRING, name: STRING>, white LONG, draws LONG, black LONG")
    lines = bodies.select("lookup_id", F.posexplode(F.split("body", "\n")).alias("pos", "line")).filter(F.trim("line") != "").withColumn("o", parsed)
    useful = lines.filter("o.white IS NOT NULL OR o.draws IS NOT NULL OR o.black IS NOT NULL OR o.opening IS NOT NULL")
    last = useful.groupBy("lookup_id").agg(F.max_by("o", "pos").alias("last"), F.max_by(F.when(F.col("o.opening.name").isNotNull(), F.col("o.opening")),
                                           F.when(F.col("o.opening.name").isNotNull(), F.col("pos"))).alias("named"))
    total = F.coalesce("last.white", F.lit(0)) + F.coalesce("last.draws", F.lit(0)) + F.coalesce("last.black", F.lit(0))
    return last.select("lookup_id", F.coalesce("last.opening.eco", "named.eco").alias("code"), F.coalesce("last.opening.name", "named.name").alias("name"), total.alias("total_games"))


def load_lookup_cache(rows: DataFrame) -> DataFrame:
    """Of appended cache rows the latest of each key, without negative totals; rows without ids are to be asked again."""
    w = Window.partitionBy("state_key").orderBy(F.desc("saved_at"))
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1 AND total_games >= 0").drop("n").withColumn(
        "ask_again", F.coalesce(F.size("top_games"), F.lit(0)) <= 0)


def save_lookup_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_templates(spark: SparkSession, *paths: str) -> DataFrame:
    """Layouts with defaults, ordered by name."""
    schema = "id STRING, name STRING, keywords ARRAY<STRING>, screenshotFilename STRING, isBuiltIn BOOLEAN, config MAP<STRING,STRING>"
    return spark.read.schema(schema).option("multiLine", True).json(list(paths)).select(
        "id", F.coalesce("name", "id").alias("name"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("isBuiltIn", F.lit(False)).alias("built_in"), "config").filter("id IS NOT NULL")


def game_text(moves: DataFrame, tags: DataFrame) -> DataFrame:
    """One text for each stream: header tags, numbered transitions with comments, nested branches, result.

    moves: (stream_id, order_key, depth, opens, closes, number, move, eval, reading). ``opens`` and ``closes``
    say how many branches start before and end after the row.
    """
    comment = F.concat_ws(" ", F.when(F.col("eval").isNotNull(), F.concat(F.lit("[%eval "), "eval", F.lit("]"))), F.when(F.col("reading").isNotNull(), F.concat(F.lit("[%clk "), "reading", F.lit("]"))))
    piece = F.concat(F.repeat(F.lit("( "), F.col("opens")), F.concat_ws(" ", "number", "move"), F.when(comment != "", F.concat(F.lit(" { "), comment, F.lit(" }"))).otherwise(""), F.repeat(F.lit(" )"), F.col("closes")))
    body = moves.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_key", piece.alias("piece")))), lambda x: x["piece"]), " ").alias("body"))
    head = tags.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "value"))), lambda x: F.format_string('[%s "%s"]', x["key"], x["value"])), "\n").alias("head"),
                                         F.max(F.when(F.col("key") == "Result", F.col("value"))).alias("result"))
    return body.join(head, "stream_id", "left").select("stream_id", F.concat_ws("\n\n", "head", F.concat_ws(" ", "body", F.coalesce("result", F.lit("*")))).alias("value"))


def export_game_text(texts: DataFrame, path: str) -> None:
    texts.write.mode("error").partitionBy("stream_id").text(path)


def export_cues(streams: DataFrame, cues: DataFrame) -> DataFrame:
    """Caption blocks, numbered within a stream; a stream without cues has a default one."""
    from obsline.operators.windows import cue_ends

    sound = cues.filter(F.col("seconds").isNotNull() & ~F.isnan("seconds") & (F.abs("seconds") != float("inf"))).withColumn("seconds", F.greatest("seconds", F.lit(0.0)))
    timed = cue_ends(sound)
    every = streams.select("stream_id").join(timed.select("stream_id", "seconds", "cue_end", "text", "seq"), "stream_id", "left").select(
        "stream_id", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("cue_end", F.lit(5.0)).alias("cue_end"), F.coalesce("text", F.lit("")).alias("text"), "seq")
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("seconds", "seq"))
    return every.withColumn("cue", n).withColumn("block", F.format_string("%d\n%s --> %s\n%s\n", F.col("cue"), cue_time(F.col("seconds")), cue_time(F.col("cue_end")), F.col("text")))


def export_state_durations(rows: DataFrame) -> DataFrame:
    """Durations by state, those that are not positive left out, but for a stream's last."""
    from obsline.operators.windows import state_durations

    last = F.lead("seq").over(Window.partitionBy("stream_id").orderBy("seconds", "seq")).isNull()
    return state_durations(rows, "end_seconds").withColumn("is_last", last).filter("duration > 0 OR is_last").drop("is_last")


def write_report(df: DataFrame, path: str) -> None:
    """Reports as JSON, a folder for each report id."""
    df.write.mode("error").partitionBy(*[c for c in ("report_id",) if c in df.columns]).json(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames; crop_frames cuts them by geometry."""
    return spark.read.parquet(path)


def crop_frames(frames: DataFrame) -> DataFrame:
    """The pixels inside (x, y, w, h), row by row, in expressions alone."""
    row = lambda r: F.substring("pixels", ((F.col("y") + r) * F.col("width") + F.col("x")) * 3 + 1, F.col("w") * 3)
    cut = F.aggregate(F.sequence(F.lit(0), F.col("h") - 1), F.lit(b"").cast("binary"), lambda a, r: F.concat(a, row(r)))
    return frames.withColumn("pixels", F.when(F.col("h") > 0, cut)).withColumn("height", F.col("h")).withColumn("width", F.col("w")).drop("x", "y", "w", "h")


def diagnostic_bundle(events: DataFrame, reports: DataFrame, compact: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """(report_id, part, body): a report, its records, compact observations (first states by key) and summary (counts by event), of its window.

    Bodies are JSON. ``compact`` has stream_id, observation_key and ts; without it that part is left out.
    """
    from obsline.operators.joins import in_interval

    bounds = reports.select("report_id", "stream_id", "start", "stop")
    mine = in_interval(events, bounds, ts)

    def part(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select("report_id", F.lit(name).alias("part"), F.to_json(F.struct(*columns)).alias("body"))

    found = part(reports, "report", *reports.columns).unionByName(part(mine, "events", *[c for c in events.columns]))
    found = found.unionByName(part(mine.groupBy("report_id", "event").agg(F.count("*").alias("n")), "summary", "event", "n"))
    if compact is None:
        return found
    seen = in_interval(compact, bounds, ts).groupBy("report_id", "observation_key").agg(F.min(ts).alias("first_ts"))
    return found.unionByName(part(seen, "observations", "observation_key", "first_ts"))


def write_bundle(bundle: DataFrame, path: str) -> None:
    """A folder for each part, a line for each row, compressed, as bodies repeat their field names."""
    bundle.write.mode("error").partitionBy("part").json(path, compression="gzip")


def read_bundle(spark: SparkSession, path: str, report_id: str = "long") -> DataFrame:
    """(report_id, part, body) as written; with its types given, as finding them takes a pass over all bodies."""
    return spark.read.schema(f"report_id {report_id}, body string, part string").json(path)
