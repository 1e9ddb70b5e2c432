"""Incremental best-epoch / early-stop tracking over a growing metric log.

The batch queries answer "which epoch was best" after the fact; a running fit
appends its metric rows to a Parquet folder while it trains.  This module
follows that folder with Structured Streaming and keeps, per run, the state
the reference keeps in its training loop - best score, best epoch, epochs
waited, stopped - with ``applyInPandasWithState`` (state = a few numbers per
run, so it stays small however long the run is).  Each micro-batch emits the
updated state of the runs it touched.

Epochs of one run must arrive in order across micro-batches (a fit appends
them in order); within a micro-batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from partyframe.sources.io import METRIC_SCHEMA

STATE_SCHEMA = "best double, best_epoch int, waiting int, stopped_at int"
OUT_SCHEMA = "run_id string, best_score double, best_epoch int, waiting int, stop_epoch int, last_epoch int"


def _tracker(patience: int | None, higher_is_better: bool):
    def update(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            best, best_epoch, waiting, stopped = state.get
        else:
            best, best_epoch, waiting, stopped = (-1.0 if higher_is_better else float("inf")), -1, 0, -1
        last = best_epoch
        rows = pd.concat(list(pdfs)).sort_values("step")
        for step, value in zip(rows["step"], rows["value"]):
            last = int(step)
            if stopped >= 0:
                continue                      # the reference stops reading once it has stopped
            better = value > best if higher_is_better else value < best
            if better:
                best, best_epoch, waiting = float(value), int(step), 0
            else:
                waiting += 1
                if patience is not None and waiting > patience:
                    stopped = int(step)
        state.update((best, best_epoch, waiting, stopped))
        yield pd.DataFrame({"run_id": [key[0]], "best_score": [best], "best_epoch": [best_epoch],
                            "waiting": [waiting], "stop_epoch": [stopped if stopped >= 0 else None],
                            "last_epoch": [last]})
    return update


def track_best_epoch(metrics: DataFrame, tag: str, patience: int | None = None,
                     higher_is_better: bool = True) -> DataFrame:
    """Stateful per-run tracker over a (streaming) metric frame ``(run_id, tag, step, value)``."""
    scores = metrics.filter(F.col("tag") == tag).select("run_id", "step", "value")
    return scores.groupBy("run_id").applyInPandasWithState(
        _tracker(patience, higher_is_better), OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def follow_metric_log(spark: SparkSession, path: str, tag: str, checkpoint: str, patience: int | None = None,
                      sink_table: str | None = None, output_path: str | None = None, available_now: bool = True):
    """Start the tracker on the metric folder ``path``.

    ``checkpoint`` must be on shared storage (e.g. under ``spark.checkpoint.dir``)
    so the state survives a lost executor or a restarted driver.  Output goes
    to a memory table (``sink_table``, tests / notebooks) or is appended per
    micro-batch to Parquet at ``output_path``.
    """
    stream = spark.readStream.schema(METRIC_SCHEMA).parquet(path)
    tracked = track_best_epoch(stream, tag, patience)
    w = tracked.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    if sink_table:
        return w.outputMode("update").format("memory").queryName(sink_table).start()

    def to_parquet(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("micro_batch", F.lit(batch_id)).write.mode("append").parquet(output_path)

    return w.outputMode("update").foreachBatch(to_parquet).start()
