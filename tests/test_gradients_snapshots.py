"""Parameter gradients summed in the JVM, stored snapshots that score by joins, message totals seen while writing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partyframe.operators import evaluate, fit, model
from partyframe.sources import io

SIZES, DIM = [3, 2], 4


def _rows(spark, n=90, batch=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=SIZES[0]).tolist(), rng.normal(size=SIZES[1]).tolist(), int(rng.random() < 0.4),
             i // batch, min(batch, n - i // batch * batch)) for i in range(n)]
    ddl = "uid long, x0 array<double>, x1 array<double>, y int, batch_id long, batch_rows long"
    return spark.createDataFrame(rows, ddl), pd.DataFrame(rows, columns=["uid", "x0", "x1", "y", "batch_id", "S"])


def _gradients(df, params, act, p, pos_weight=2.5, lam=0.3):
    sc = model.head(model.embed(df, params, SIZES, act, keep_pre=True), params)
    g = model.grad_embeddings(model.grad_z_binary(sc, pos_weight), params, penalty_p=p, lam=lam, divisor=2.0)
    return model.weight_gradients(g, params, act)


@pytest.mark.parametrize("act,penalty", [("relu", 1), ("leaky_relu", 2), ("elu", 1), ("selu", 2), ("mish", 0),
                                         ("identity", 1)])
def test_weight_gradients_equal_the_batchwise_numpy_pass(spark, act, penalty):
    df, pdf = _rows(spark)
    params = model.rule_params(SIZES, DIM)
    P = dict(params.flat())
    flat = fit.Flat(P)
    cfg = fit.JointConfig(in_sizes=SIZES, dims=[DIM] * 2, act=act, codec=None, lam=0.3 if penalty else 0.0,
                          penalty_p=penalty or 1, divisor=2.0, pos_weight=2.5)
    want = sum(fit.joint_batch(b, P, cfg, flat)[:flat.size] for _, b in pdf.groupby("batch_id"))
    got = _gradients(df, params, act, penalty)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    rows = {r["k"]: r["v"] for r in got.collect()}
    assert sorted(rows) == list(range(flat.size))
    np.testing.assert_allclose([rows[k] for k in range(flat.size)], want, atol=1e-12)


def test_weight_gradients_of_no_rows_and_without_bias(spark):
    df, _ = _rows(spark)
    params = model.rule_params(SIZES, DIM)
    assert _gradients(df.limit(0), params, "relu", 1).count() == 0
    params.bias = False
    flat = fit.Flat(dict(params.flat()))
    got = {r["k"]: r["v"] for r in _gradients(df, params, "relu", 1).collect()}
    g = flat.unpack(np.array([got[k] for k in range(flat.size)]))
    assert not g["party0.b"].any() and not g["party1.b"].any() and g["party0.W"].any()


def test_stored_snapshots_score_as_literal_weights(spark, tmp_path):
    df, _ = _rows(spark)
    every = {(run, e): model.rule_params(SIZES, DIM, salt=e + shift)
             for run, shift in (("a", 0), ("b", 5)) for e in range(2)}
    for (run, e), params in every.items():
        io.write_params(spark, dict(params.flat()), run, e, str(tmp_path / "p"))
    io.write_params(spark, dict(every["a", 1].flat()), "a", 1, str(tmp_path / "p"))        # a repeated write
    models = model.snapshot_models(spark.read.parquet(str(tmp_path / "p")))
    assert models.count() == 4
    both = df.withColumn("run_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("unknown"))))
    got = model.score_snapshots(both, models, 2, "elu").select("run_id", "epoch", "uid", "z").collect()
    assert len(got) == 4 * df.count()
    for (run, e), params in every.items():
        want = {r["uid"]: r["z"][0] for r in model.head(model.embed(df, params, SIZES, "elu"), params).collect()}
        mine = {r["uid"]: r["z"][0] for r in got if (r["run_id"], r["epoch"]) == (run, e)}
        assert mine == pytest.approx(want, abs=1e-12)


def test_totals_seen_while_writing_equal_the_sums_of_what_was_written(spark, tmp_path):
    msgs = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "tr").otherwise("va").alias("split"), (F.col("id") % 2).cast("int").alias("party"),
        F.col("id").alias("batch_id"), (F.col("id") % 7).cast("int").alias("samples"),
        (F.col("id") * 31 % 1009).alias("bytes"), F.lit("send").alias("direction"))
    seen = io.write_counted_messages(msgs, str(tmp_path / "m"), [0, 1, 2])
    again = io.write_counted_messages(msgs, str(tmp_path / "m"), [0, 1, 2])                # appended, counted alone
    assert seen == again and seen[2] == {"messages": 0, "bytes": 0, "rows": 0}
    totals = evaluate.comm_totals(msgs).filter("party is not null and direction is not null").collect()
    assert {r["party"]: (r["messages"], r["bytes"]) for r in totals} == {
        p: (seen[p]["messages"], seen[p]["bytes"]) for p in (0, 1)}
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert stored.count() == 2000 and stored.agg(F.sum("samples")).first()[0] == 2 * (seen[0]["rows"] + seen[1]["rows"])
    empty = io.write_counted_messages(msgs.limit(0), str(tmp_path / "e"), [0])
    assert empty == {0: {"messages": 0, "bytes": 0, "rows": 0}}
    with pytest.raises(ValueError, match="other parties"):
        io.write_counted_messages(msgs, str(tmp_path / "x"), [0])
