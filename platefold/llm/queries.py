"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, bpe_count, idstore, langid, ledger, lm, lsm, merkle, oracles, packing, quality, search, simhash, spm
from .common import fold

TOKENS = 1024


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), TOKENS).drop("ids")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_docs(spark, sf_dir), F.col("doc_id") % 20 == 0, most=None).withColumn("score", F.round("score", 9))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 1
    found = lm.score(_docs(spark, sf_dir), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > TOKENS)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = fold(F.col("doc_id"), 4) == 2
    return langid.predict(docs, langid.learn(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.exact_groups(_docs(spark, sf_dir), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    return quality.rank(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.write_and_read(_docs(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(_docs(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.search(bitslice.build_index(_docs(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.Ledger(spark).scan(_docs(spark, sf_dir), "doc_id")
    base = F.filter("findings", lambda x: x["kind"].isin(*ledger.BASE))
    of_kind = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in ledger.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(ledger.listed(base).cast("binary"), 256).alias("base_sha256"), ledger.listed(F.col("findings")).alias("spans"), "blob")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = merkle.verified(docs, other={"text": lowered}, where=F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_packing, op3_search, op4_lm_scores, op5_token_counts, op6_language_id, op7_exact_dedup, op8_quality, op9_id_store, op10_sentencepiece, op11_impact_search, op12_secret_ledger, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            with d as (select doc_id, coalesce(text, '') t from documents)
            select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
                   doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256
            from d""",
        "op11_impact_search": oracles.IMPACT_SEARCH,
        "op12_secret_ledger": oracles.secret_ledger(),
        "op13_merkle_manifest": oracles.merkle_manifest(),
    }
