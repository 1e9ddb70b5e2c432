"""From documents to packed sequences: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared checkpoint folder and reads it again as the next
stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.llm.common import row_struct
from partyframe.llm.decontaminate import leaking_texts, text_key
from partyframe.llm.jaccard import near_texts
from partyframe.llm.packing import pack
from partyframe.llm.quality import rate_quality
from partyframe.llm.substring import remove_repeats
from partyframe.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity passes their language's threshold go.

    Trusted text is what ``labels`` marks with quality 1.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    kept = rate_quality(docs.select("doc_id", "text", "lang"), trusted).filter("kept").select(
        F.col("text_hash").alias("h"), F.col("lang").alias("l")).distinct()
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"), F.col("lang").alias("l"),
                       row_struct(docs).alias("row"))
    same = (rows["h"] == kept["h"]) & rows["l"].eqNullSafe(kept["l"])
    return rows.join(kept, same, "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 on five-word shingles, the document with the smallest id stays.

    Rows that repeat both id and text are one document; documents without words stay.
    """
    kept = near_texts(docs.select("doc_id", "text")).filter("kept").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"),
                       row_struct(docs).alias("row"))
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["h"] == kept["h"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "h"]).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that stand earlier go; documents of which nothing is left go too."""
    cut = remove_repeats(docs.select("doc_id", "text", row_struct(docs).alias("row")), 20, as_is=True)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [(F.when(F.col("changed"), changed[c]).otherwise(F.col("row").getField(c)).alias(c) if c in changed
                else F.col("row").getField(c).alias(c)) for c in docs.columns]
    return cut.filter("n_removed = 0 or n_removed < n_words").select(*columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    leaks = leaking_texts(docs.select("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.select(text_key("text").alias("key"), row_struct(docs).alias("row"))
    return rows.join(leaks.select("key").distinct(), "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in sequences of 1024."""
    return pack(docs.select("doc_id", "text"), 1024)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Neither trained perplexities nor packing can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
