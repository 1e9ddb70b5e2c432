"""Contiguous shards of equal byte size (prefix sums from per-partition totals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Cut the rows, in order of (id, text), into ``n_shards`` runs of near equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1).  Only
    (id, size, crc32) move: the rows are dealt out by range and written once,
    so that every later step sees the same partitions.  Totals of the
    partitions (one row each) give each its byte and row offset; the running
    sum inside a partition does the rest.  A row goes to the shard in which
    its middle byte falls, so a shard's size differs from the mean by at most
    one row at either end.

    Returns (id_col, size, text_crc32, shard, slot), one row per input row.
    Null ids come first; equal rows are told apart by their place in the
    input, so one key held by a third of the rows is still split.  Rows of
    which all three values are equal may change places, which changes nothing
    in the result.  An empty table gives no rows.  Extra columns are ignored.
    """
    placed = _placed(docs, n_shards, id_col, text_col)
    # n_shards rows, whatever the input
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"))


def cut_points(docs: DataFrame, n_shards: int, id_col: str, text_col: str) -> list[tuple[int, int]]:
    """(id, crc32) of the first row of each shard but the first: at most ``n_shards - 1`` small pairs.

    A null id is written as the smallest long.
    """
    placed = _placed(docs, n_shards, id_col, text_col)
    lowest = F.lit(-(1 << 63)).cast("long")
    firsts = (placed.groupBy("shard").agg(F.min(F.struct(F.coalesce("id", lowest).alias("id"), "crc")).alias("first"))
              .orderBy("shard").collect())
    return [(r["first"]["id"], r["first"]["crc"]) for r in firsts[1:]]


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, place, shard): place and shard of each row in the order of (id, crc)."""
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("crc"),
        F.monotonically_increasing_id().alias("tie"))
    order = ["id", "crc", "size", "tie"]
    parted = checkpointed(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = parted.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    # one row per partition: the window below runs over partitions, not over rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(every).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (parted.join(offsets, "part")
              .withColumn("start", start)
              .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
              # decimal: 2 * bytes * shards passes 2^63 only beyond 10^17 bytes, but the plan should not depend on it
              .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(
                  (F.col("start") * 2 + F.col("size")).cast("decimal(30,0)") * n_shards
                  / (F.col("all_bytes") * 2)).cast("int"))))
