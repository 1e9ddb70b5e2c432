"""Registered queries of the training-data operators; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, oracles, toxicity
from .collocations import collocations
from .common import fold_of
from .decontaminate import find_leaks
from .jaccard import near_texts
from .katz import katz_scores
from .lexical import search
from .metricjoin import near_vectors
from .packing import pack
from .quality import rate_quality
from .rules import rate_by_rules
from .sharding import shard_by_bytes
from .substring import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    rated = rate_quality(docs.select("doc_id", "text", "lang"), labels.filter("quality = 1"))
    return rated.select("doc_id", "n_tokens", "perplexity", "threshold", "kept")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id") == 0
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score",
                                               F.size("spans").alias("n_spans"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = fold_of("doc_id") == 0
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), 1024)


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = katz_scores(docs, fold_of("doc_id") != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_texts(docs, 0.8).select("doc_id", "class_id", "n_links", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_bytes(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, 20).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate_by_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "p_good", "kept")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), 20)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_embeddings": op3_embeddings,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_katz": op7_katz,
    "op8_jaccard": op8_jaccard,
    "op9_sharding": op9_sharding,
    "op10_substring": op10_substring,
    "op11_rules": op11_rules,
    "op12_lexical": op12_lexical,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_embeddings": oracles.EMBEDDINGS,
    "op8_jaccard": oracles.JACCARD,
    "op10_substring": oracles.SUBSTRING,
    "op12_lexical": oracles.LEXICAL,
    "op13_collocations": oracles.COLLOCATIONS,
}
