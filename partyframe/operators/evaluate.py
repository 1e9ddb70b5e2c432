"""Scores, epoch selection and byte accounting.

* AUC is exact with ties: one row per distinct score (a partial aggregation),
  then the number of negatives below each score as a running sum over ranges
  (:func:`running_sum`), so no global one-partition window is planned.
* Macro-F1 comes from the confusion table (one row per (truth, prediction)).
* Best epoch / early stop are windows per run over the epoch table, whose
  size is the number of epochs, not of rows.
* Accounting is ``rollup`` over message sizes, which yields the per-party,
  per-direction and grand totals in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyframe.operators.index import running_sum


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ E1

def auc(df: DataFrame, score: str, label: str, by: tuple = (), out: str = "auc") -> DataFrame:
    """Exact ROC AUC per group: ``sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)``.

    Equal scores count one half, as the rank-sum formula with mid-ranks does.
    A group with only one class gets null (the metric is undefined there).
    The running sum deals out the distinct scores by range, so tasks stay
    balanced however the scores cluster.
    """
    by = list(by)
    y = F.col(label).cast("long")
    per = df.groupBy(*by, F.col(score).cast("double").alias("_pf_s")).agg(
        F.sum(y).alias("_pf_pos"), F.sum(F.lit(1) - y).alias("_pf_neg"))
    ranked = running_sum(per, ["_pf_s"], "_pf_neg", out="_pf_below", partition_by=by)
    contrib = F.col("_pf_pos") * (F.col("_pf_below") + F.col("_pf_neg") / F.lit(2.0))
    g = ranked.groupBy(*by).agg(F.sum(contrib).alias("_pf_c"), F.sum("_pf_pos").alias("n_pos"),
                                F.sum("_pf_neg").alias("n_neg"))
    denom = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return g.select(*by, F.col("n_pos").cast("long"), F.col("n_neg").cast("long"),
                    F.when(denom > 0, F.col("_pf_c") / denom).alias(out))


# ------------------------------------------------------------------ E2

def confusion(df: DataFrame, truth: str, pred: str, by: tuple = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, truth: str, pred: str, by: tuple = (), out: str = "macro_f1") -> DataFrame:
    """Plain mean of per-class F1 over the classes seen in truth or prediction.

    ``F1_c = 2 tp / (support_c + predicted_c)``; a class seen on one side only has F1 0.
    """
    by = list(by)
    conf = confusion(df, truth, pred, by)
    roles = F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("tp")))
    per = (conf.select(*by, F.explode(roles).alias("r"))
           .groupBy(*by, F.col("r.cls").alias("cls"))
           .agg(F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.tp").alias("tp")))
    f1 = F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("predicted"))
    return per.groupBy(*by).agg(F.avg(f1).alias(out), F.count(F.lit(1)).alias("classes"))


# ------------------------------------------------------------------ W7, W8

def _number(score: str) -> Column:
    """The score, or null where it is NaN (Spark ranks NaN above all numbers)."""
    return F.when(~F.isnan(F.col(score).cast("double")), F.col(score))


def mark_improvements(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch", score: str = "score",
                      higher_is_better: bool = True, start: float = -1.0) -> DataFrame:
    """``improved`` = score strictly better than every earlier epoch (first maximum wins).

    The reference starts from -1 for a score (AUC / F1) and from +inf for a loss.
    A NaN score (an undefined AUC) counts as none: it never improves.  Adds ``improved`` (0/1) and ``best_so_far``.
    """
    w_prev = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    s = _number(score)
    if higher_is_better:
        prev = F.coalesce(F.max(s).over(w_prev), F.lit(start))
        improved = s > prev
    else:
        prev = F.coalesce(F.min(s).over(w_prev), F.lit(float("inf")))
        improved = s < prev
    w_run = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = (F.greatest(F.max(s).over(w_run), F.lit(start)) if higher_is_better
            else F.min(s).over(w_run))
    return epochs.withColumn("improved", F.coalesce(improved.cast("int"), F.lit(0))).withColumn("best_so_far", best)


def best_epoch(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch", score: str = "score",
               higher_is_better: bool = True) -> DataFrame:
    """Per run the last improving epoch (= first epoch reaching the best score)."""
    m = mark_improvements(epochs, run, epoch, score, higher_is_better)
    return m.groupBy(run).agg(
        F.max(F.when(F.col("improved") == 1, F.col(epoch))).alias("best_epoch"),
        (F.max(_number(score)) if higher_is_better else F.min(_number(score))).alias("best_score"),
        F.sum("improved").cast("long").alias("improvements"),
        F.count(F.lit(1)).alias("epochs"))


def early_stop(epochs: DataFrame, patience: int, run: str = "run_id", epoch: str = "epoch",
               score: str = "score", higher_is_better: bool = True) -> DataFrame:
    """The counter resets on improvement and grows by one otherwise; training stops at
    the first epoch where it exceeds ``patience``.  Per run: ``stop_epoch`` (null = ran to the
    end), epochs actually run, and the best epoch among them."""
    m = mark_improvements(epochs, run, epoch, score, higher_is_better)
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    last_imp = F.max(F.when(F.col("improved") == 1, F.col("_pf_pos"))).over(w)
    pos = F.row_number().over(Window.partitionBy(run).orderBy(epoch)) - 1
    m = m.withColumn("_pf_pos", pos).withColumn(
        "waiting", F.col("_pf_pos") - F.coalesce(last_imp, F.lit(-1)))
    stops = m.groupBy(run).agg(F.min(F.when(F.col("waiting") > patience, F.col("_pf_pos"))).alias("_pf_stop"))
    kept = m.join(stops, run).filter(F.col("_pf_stop").isNull() | (F.col("_pf_pos") <= F.col("_pf_stop")))
    g = kept.groupBy(run).agg(
        F.max(F.when(F.col("_pf_pos") == F.col("_pf_stop"), F.col(epoch))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
        F.max(F.when(F.col("improved") == 1, F.struct(F.col("_pf_pos"), F.col(epoch).alias("e"),
                                                      F.col(score).alias("s")))).alias("_pf_b"))
    return g.select(run, "stop_epoch", "epochs_run", F.col("_pf_b.e").alias("best_epoch"),
                    F.col("_pf_b.s").alias("best_score"))


# ------------------------------------------------------------------ A9, A10

def comm_totals(msgs: DataFrame, keys: tuple = ("party", "direction"), bytes_col: str = "bytes") -> DataFrame:
    """Message count and bytes by ``rollup(keys)`` (per key, subtotals, grand total),
    with mean KiB per message and GiB."""
    g = msgs.rollup(*keys).agg(F.count(F.lit(1)).alias("messages"), F.sum(bytes_col).cast("long").alias("bytes"))
    return (g.withColumn("kib_per_message", F.col("bytes") / F.col("messages") / F.lit(1024.0))
            .withColumn("gib", F.col("bytes") / F.lit(float(2 ** 30))))


def run_record(sizes: DataFrame, run_cols: list[str], parties: list[int], directions=("send", "receive"),
               party: str = "party", direction: str = "direction", bytes_col: str = "bytes") -> DataFrame:
    """One row per run, bytes per party and direction as columns (``total_size_<dir>_<p>``).

    The pivot values are given, so the schema is fixed and no extra job runs to
    find them.
    """
    key = F.concat(F.lit("total_size_"), F.col(direction), F.lit("_"), F.col(party).cast("string"))
    values = [f"total_size_{d}_{p}" for d in directions for p in parties]
    wide = sizes.withColumn("_pf_key", key).groupBy(*run_cols).pivot("_pf_key", values).agg(
        F.sum(bytes_col).cast("long"))
    total = None
    for v in values:
        t = F.coalesce(F.col(v), F.lit(0))
        total = t if total is None else total + t
    return wide.withColumn("total_size_all", total)
