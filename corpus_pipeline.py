"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder
and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsline.llm.common import discard, held_out, materialise, scratch, table, text_bytes, write_shared
from obsline.llm.exact_dedup import exact_groups
from obsline.llm.packing import pack
from obsline.llm.simhash import near_duplicates
from obsline.llm.toxicity import THRESHOLD, fit, score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(names: list[str], name: str) -> str:
    """A column name that is not among ``names``; it is added to them."""
    while name.lower() in {n.lower() for n in names}:
        name = "_" + name
    names.append(name)
    return name


def _keep(docs: DataFrame, decisions: DataFrame, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, mark) is in ``decisions``; one row where such a pair repeats.

    Pairs that repeat are rare, so only their rows are numbered. All joins go by the whole pair, so that rows
    with one id, or none, spread by their marks.
    """
    names = list(docs.columns)
    key, ident, at = (_free(names, n) for n in ("stage_mark", "stage_id", "stage_at"))
    kept = decisions.select(F.col("doc_id").alias(ident), F.col("mark").alias(key)).distinct()
    marked = docs.withColumn(key, mark)
    again = marked.groupBy(F.col("doc_id").alias(ident), key).agg(F.count("*").alias(at)).filter(F.col(at) > 1).select(ident, key)

    def among(df: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        return df.join(pairs, F.col("doc_id").eqNullSafe(pairs[ident]) & (df[key] == pairs[key]), how)

    stay = among(marked, kept, "left_semi")
    once = among(stay, again, "left_anti")
    more = among(stay, again, "left_semi").withColumn(
        at, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*docs.columns)))).filter(F.col(at) == 1).drop(at)
    return once.unionByName(more).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold stay, by a model of the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2))
    model = fit(docs.select("doc_id", "text"), labels)
    name = _free(list(docs.columns), "stage_score")
    return score(docs, model, carry=name).filter(F.col(name) < THRESHOLD).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id stays."""
    kept = exact_groups(docs.select("doc_id", "text")).filter("kept").select("doc_id", F.col("text_sha256").alias("mark"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return _keep(docs, materialise(kept), F.sha2(plain, 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the least doc_id, then the least hash of its text.

    Ids may be null or repeat, so a row goes by its id and its text's hash; a null id comes after all others.
    """
    content = F.sha2(text_bytes(), 256)
    ident = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.unhex(content).alias("content"))
    found = near_duplicates(docs.select(ident.alias("doc_id"), "text"))
    kept = found.filter("doc_id = component_id").select("doc_id.doc_id", F.lower(F.hex("doc_id.content")).alias("mark"))
    return _keep(docs, materialise(kept), content)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: Hashing, learning and tokenizers are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what stages write on the way goes when the next one's input stands."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            before, path = path, write_shared(found)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            discard(spark, before)
    return docs
