"""Shared inputs derived from the test tables (and their SQL twins).

Roles (entity = order):
* embeddings: one party's 64-wide embedding per ``vec_id``; ReLU makes it
  about half sparse.  Batches of ``EMB_BATCH`` rows in ``vec_id`` order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.operators.index import assign_batches
from partyframe.sources.tables import read_table

# fixed values: test-query parameters
EMB_BATCH = 128
TOPK = 100


def relu_array(col: str) -> F.Column:
    return F.transform(col, lambda v: F.greatest(v, F.lit(0.0)).cast("float"))


def embedding_batches(spark: SparkSession, sf_dir: str, relu: bool = True,
                      batch_size: int = EMB_BATCH) -> DataFrame:
    """(vec_id, label, e ARRAY<FLOAT>, raw ARRAY<FLOAT>, batch_id, row_in_batch, batch_rows)."""
    emb = read_table(spark, sf_dir, "embeddings")
    e = relu_array("embedding") if relu else F.col("embedding")
    df = emb.select("vec_id", "label", e.alias("e"), F.col("embedding").alias("raw"))
    return assign_batches(df, ["vec_id"], batch_size)


# SQL twin of embedding_batches (DuckDB); ``e`` is the ReLU'd vector, ``raw`` the input.
SQL_EMB_BATCHES = f"""
eb AS (
  SELECT vec_id, label, embedding AS raw,
         list_transform(embedding, lambda v: greatest(v, 0::FLOAT)) AS e,
         row_number() OVER (ORDER BY vec_id) - 1 AS idx,
         count(*) OVER () AS n
  FROM embeddings),
b AS (
  SELECT vec_id, label, raw, e, idx // {EMB_BATCH} AS batch_id, idx % {EMB_BATCH} AS i,
         least({EMB_BATCH}, n - (idx // {EMB_BATCH}) * {EMB_BATCH}) AS S, len(e) AS dims
  FROM eb),
cells0 AS (
  SELECT vec_id, label, batch_id, i, S, dims, unnest(range(0, dims)) AS dd, unnest(e) AS v, unnest(raw) AS rv FROM b),
cells AS (
  SELECT *, dd * S + i AS pos_col, i * dims + dd AS pos_row FROM cells0)
"""


def sql_ceil_log2(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 1 THEN 0 ELSE length(bin(({x}) - 1)) END)"


def sql_bytes(bits: str) -> str:
    return f"((({bits}) + 7) // 8)"


def sql_fp16(x: str) -> str:
    """DuckDB twin of functions.fp16_round."""
    ax = f"abs(({x})::DOUBLE)"
    e = f"greatest(floor(log2({ax})), -14)"
    step = f"pow(2.0, {e} - 10)"
    return (f"(CASE WHEN isnan(({x})::DOUBLE) THEN ({x})::DOUBLE WHEN {ax} = 0 THEN ({x})::DOUBLE "
            f"WHEN {ax} >= 65520 THEN sign(({x})::DOUBLE) * 'inf'::DOUBLE "
            f"ELSE round_even(({x})::DOUBLE / {step}, 0) * {step} END)")
