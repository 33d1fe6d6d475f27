"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result
is written as Parquet and read again as the next one's docs.  All stages but the last return
the columns of documents.  A row without a doc_id cannot be referred to and leaves in the first
stage; texts that are null or empty have no language and leave in the second.
"""

from __future__ import annotations

import public_tokenizers
from platefold.llm import common, langid, lsm, packing, quality, simhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 1024


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; of rows that share an id all stay if one of them is accepted."""
    learn_from = common.fold(F.col("doc_id"), 4) != 2
    ranked = quality.rank(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from)
    return docs.join(ranked.where("predicted = 1").select("doc_id").distinct(), "doc_id", "left_semi")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the languages that occur in lang: more alike to it than chance
    makes letters of no learned language. Of rows that share an id all stay if one of them does."""
    prototypes = langid.learn(docs, common.fold(F.col("doc_id"), 4) != 2)
    found = langid.predict(docs, prototypes)
    written = (F.col("lang_pred") != "und") & langid.written_in(F.col("likeness"), F.col("n_grams"))
    return docs.join(found.where(written).select("doc_id").distinct(), "doc_id", "left_semi")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least id; of a repeated row, one."""
    sha = next(n for n in ("_sha" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    kept = lsm.exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias(sha))
    marked = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return marked.join(kept, ["doc_id", sha], "left_semi").dropDuplicates(["doc_id", sha]).drop(sha).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the least id."""
    groups = simhash.near_duplicate_groups(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in windows."""
    with common.small_batches(spark):  # the stages before leave the executors less memory than packing alone has
        return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), WINDOW).drop("ids")


STAGES = [("quality", keep_quality), ("language", keep_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]
#: Ranking, profiles, near copies and packing cannot be put in SQL; tests/llm compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
