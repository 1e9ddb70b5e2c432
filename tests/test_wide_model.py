"""Linear layers at the reference's own widths: small plans, exact results."""

import time

import numpy as np
from pyspark.sql import functions as F

from partyframe.operators import compress, model

WIDTHS = [28, 35, 45]


def test_scoring_108_inputs_matches_numpy_without_a_large_plan(spark):
    rng = np.random.default_rng(0)
    params = model.rule_params(WIDTHS, 8, 1)
    x = [rng.normal(size=(50, w)) for w in WIDTHS]
    df = spark.createDataFrame([(i, *[v[i].tolist() for v in x]) for i in range(50)],
                               "uid long, x0 array<double>, x1 array<double>, x2 array<double>")
    out = model.head(model.embed(df, params, WIDTHS), params)
    e = [np.maximum(v @ W + b, 0) for v, (W, b) in zip(x, params.party)]
    h = np.maximum(np.concatenate(e, 1) @ params.hidden[0] + params.hidden[1], 0)
    z = h @ params.out[0] + params.out[1]
    got = {r["uid"]: r["z"][0] for r in out.select("uid", "z").collect()}
    np.testing.assert_allclose([got[i] for i in range(50)], z[:, 0], rtol=1e-9)
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(
        out._jdf.queryExecution().executedPlan())
    assert len(code) < 200_000 and "Code of method" not in code


def test_pca_codes_of_512_columns_plan_in_a_second(spark):
    rng = np.random.default_rng(1)
    mean, pc = rng.normal(size=512), rng.normal(size=(512, 64))
    x = rng.normal(size=(20, 512))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "uid long, x array<double>")
    began = time.time()
    codes = df.select("uid", compress.pca_codes("x", mean, pc).alias("c"))
    codes._jdf.queryExecution().executedPlan()
    assert time.time() - began < 1.5
    got = {r["uid"]: list(r["c"]) for r in codes.collect()}
    np.testing.assert_allclose([got[i] for i in range(20)], (x - mean) @ pc, rtol=1e-9, atol=1e-9)
    assert codes.filter(F.size("c") != 64).count() == 0


def test_a_layer_computes_its_input_once_a_row(spark):
    """Three layers in one projection: what a layer reads per output is a bound variable, not the layers below it."""
    params = model.rule_params([2, 2, 2], 4, 3)
    df = spark.range(20).select("id", *[F.array(F.col("id") + 0.5, F.lit(1.0) * p).alias(f"x{p}") for p in range(3)])
    z = model.head(model.embed(df, params, [2, 2, 2]), params).select("id", "z")
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 5 and plan.count("zip_with(lambda ") == 5
