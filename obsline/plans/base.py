"""Views of the given tables in the shape of the operators, in Spark and as SQL with the same values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.functions.rules import normalize_label

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DETECTORS = ["yellow", "clock", "hover", "geometry"]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows: truth is quality, prediction is toxic, the rest comes from documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("label_id"), normalize_label(F.col("quality").cast("string")).alias("truth"), normalize_label(F.col("toxic").cast("string")).alias("prediction"),
        (F.col("n_chars") / 4000.0).alias("confidence"), (F.col("n_chars") % 100).cast("double").alias("score"), F.col("lang").alias("regime"),
        F.col("source").alias("component"), F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("case"), F.array("lang", "source").alias("conditions"),
        F.get(F.array(*map(F.lit, DETECTORS)), (F.col("doc_id") % 4).cast("int")).alias("detector"), (F.col("doc_id") % 97).cast("string").alias("transition_id"))


L = """L AS (SELECT l.doc_id AS label_id, CASE WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'negative' ELSE 'uncertain' END AS truth,
  CASE WHEN toxic = 1 THEN 'positive' WHEN toxic = 0 THEN 'negative' ELSE 'uncertain' END AS prediction, n_chars / 4000.0 AS confidence,
  CAST(n_chars % 100 AS DOUBLE) AS score, lang AS regime, source AS component, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS "case",
  ['yellow', 'clock', 'hover', 'geometry'][CAST(l.doc_id % 4 AS INT) + 1] AS detector, CAST(l.doc_id % 97 AS VARCHAR) AS transition_id
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

COUNTS = """count(*) FILTER (truth = 'positive' AND prediction = 'positive') AS tp, count(*) FILTER (truth = 'negative' AND prediction = 'negative') AS tn,
  count(*) FILTER (truth = 'negative' AND prediction = 'positive') AS fp, count(*) FILTER (truth = 'positive' AND prediction = 'negative') AS fn,
  count(*) FILTER (truth = 'uncertain' OR prediction = 'uncertain') AS uncertain, count(*) FILTER (truth <> 'uncertain' AND prediction <> 'uncertain') AS labeled"""

RATES = """round(tp / nullif(tp + fp, 0), 9) AS "precision", round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS fpr,
  round(fn / nullif(fn + tp, 0), 9) AS fnr, round((tp + tn) / nullif(labeled, 0), 9) AS accuracy"""


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Doubles to a number of digits, so that engines that add in another order agree."""
    cols = names or tuple(f.name for f in df.schema if f.dataType.simpleString() == "double")
    return df.withColumns({c: F.round(c, digits) for c in cols})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: a user is a stream; side by parity of the id; the reading comes from props."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("observation_id"), "ts", F.col("event_type"), "value", k.alias("k"),
        F.when(F.col("event_id") % 2 == 0, "w").otherwise("b").alias("side"), (k * 37 % 900).alias("seconds"),
        F.concat_ws(">", F.col("event_type"), (k % 3).cast("string")).alias("state"))


E = """E AS (SELECT user_id AS stream_id, event_id AS observation_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k,
  CASE WHEN event_id % 2 = 0 THEN 'w' ELSE 'b' END AS side, CAST(json_extract(props, '$.k') AS INT) * 37 % 900 AS seconds,
  event_type || '>' || CAST(CAST(json_extract(props, '$.k') AS INT) % 3 AS VARCHAR) AS state FROM events)"""

ORD = "PARTITION BY stream_id ORDER BY ts, observation_id"

#: Event names that the driver's five types stand for.
NAMES = {"view": "QUIET", "click": "CANDIDATE", "purchase": "ACCEPT", "signup": "REVERT_APPLIED", "error": "VALIDATION_REJECTED"}


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records with names, candidates and moves."""
    e = events(spark, sf_dir)
    name = F.lit("CLOCK_STATE")
    for key, value in NAMES.items():
        name = F.when(F.col("event_type") == key, value).otherwise(name)
    return e.select("*", name.alias("event"), F.lit(None).cast("string").alias("outcome"), (F.col("k") % 20).alias("candidate_id"), F.concat(F.lit("m"), (F.col("k") % 5).cast("string")).alias("move"),
                    F.col("observation_id").alias("sequence"), (F.col("k") % 3).alias("branch_id"), (F.col("k") % 2).alias("generation"), F.col("value").alias("score"))


T = E + """, T AS (SELECT *, CASE event_type WHEN 'view' THEN 'QUIET' WHEN 'click' THEN 'CANDIDATE' WHEN 'purchase' THEN 'ACCEPT' WHEN 'signup' THEN 'REVERT_APPLIED'
  WHEN 'error' THEN 'VALIDATION_REJECTED' ELSE 'CLOCK_STATE' END AS event, k % 20 AS candidate_id, 'm' || CAST(k % 5 AS VARCHAR) AS move, observation_id AS sequence,
  k % 3 AS branch_id, k % 2 AS generation, value AS score FROM E)"""


#: Ids of moved vectors lie so far beyond their own.
AGAIN = 1 << 40


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64 cells of 0 to 255 in ten streams; each vector comes back, slightly moved, after all others (column moved)."""
    base = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).alias("stream_id"), F.col("vec_id").alias("seq"), F.col("vec_id").alias("observation_id"),
        F.transform("embedding", lambda x: F.round((x.cast("double") + 0.5) * 255, 6)).alias("cells"), F.lit(False).alias("moved"))
    again = base.select("stream_id", (F.col("seq") + AGAIN).alias("seq"), (F.col("observation_id") + AGAIN).alias("observation_id"),
                        F.transform("cells", lambda x, i: x + (i % 5 - 2)).alias("cells"), F.lit(True).alias("moved"))
    return base.unionByName(again)


V = f"""V0 AS (SELECT vec_id % 10 AS stream_id, vec_id AS seq, vec_id AS observation_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) + 0.5) * 255, 6)) AS cells FROM embeddings),
V AS (SELECT * FROM V0 UNION ALL SELECT stream_id, seq + {AGAIN}, observation_id + {AGAIN}, list_transform(cells, lambda x, i: x + ((i - 1) % 5 - 2)) FROM V0)"""


def game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timelines: a turn's role and first letter stand for its state, its length for the move."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat_ws(" ", "role", F.lower(F.substring("text", 1, 1)), F.lit("-"), F.lit("-"), "turn").alias("state"),
                    (F.length("text") % 7).cast("string").alias("move"), F.timestamp_seconds(F.col("turn") * 2).alias("ts"))


G = """G AS (SELECT conv_id AS stream_id, turn AS seq, concat_ws(' ', role, lower(substr(text, 1, 1)), '-', '-', CAST(turn AS VARCHAR)) AS state,
  CAST(length(text) % 7 AS VARCHAR) AS move, CAST(turn * 2 AS BIGINT) AS t FROM conversations)"""
