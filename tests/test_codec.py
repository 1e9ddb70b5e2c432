"""Codec edge frames, round trips and size formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.functions.numeric import fp16_round
from partyframe.operators import codec, fit


def _batch(spark, rows, key=0):
    """rows: list of lists -> frame (batch_id, row_in_batch, batch_rows, e)."""
    data = [(key, i, len(rows), [float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "batch_id long, row_in_batch int, batch_rows int, e array<double>")


EDGE = {
    "all_zero": [[0, 0], [0, 0]],
    "all_nonzero": [[1, 2], [3, 4]],            # one open run, no tail
    "run_at_end": [[0, 0], [0, 5]],
    "crossing_columns": [[0, 0], [0, 1], [2, 0]],  # column-major: run crosses from d=0 to d=1
    "one_row": [[1, 0, 3]],
    "constant": [[7, 7], [7, 7], [7, 7]],
}


@pytest.mark.parametrize("name", sorted(EDGE))
@pytest.mark.parametrize("axis", [0, 1])
def test_rle_roundtrip_edges(spark, name, axis):
    rows = EDGE[name]
    b = _batch(spark, rows)
    mat = codec.batch_matrix(b, "e", axis=axis)
    msg = codec.rle_encode(mat)
    r = msg.first()
    M = np.array(rows, dtype=float)
    flat = M.T.ravel() if axis == 1 else M.ravel()
    nz = flat != 0
    prev = np.concatenate([[False], nz[:-1]])
    assert list(r["head"]) == list(np.flatnonzero(nz & ~prev))
    assert list(r["tail"]) == list(np.flatnonzero(~nz & prev))
    assert len(r["tail"]) in (len(r["head"]), len(r["head"]) - 1)
    dec = codec.decode_to_rows(msg, ["batch_id"], kind="rle", axis=axis).orderBy("row_in_batch").collect()
    got = np.array([list(d["decoded"]) for d in dec])
    np.testing.assert_array_equal(got, M.astype(np.float32))


@pytest.mark.parametrize("axis", [0, 1])
def test_decoding_runs_in_the_jvm_and_places_every_cell(spark, axis):
    rng = np.random.default_rng(11)
    M = np.where(rng.random((23, 7)) < 0.5, 0, rng.normal(size=(23, 7))).astype(np.float32)
    b = _batch(spark, M.tolist())
    sent = codec.rle_encode(codec.batch_matrix(b, "e", axis=axis))
    top = codec.topk_encode(codec.batch_matrix(b, "e", axis=0), 20)
    flat = np.abs(M.ravel())
    least = np.sort(flat)[-20]
    for msg, kind, want in ((sent, "rle", M), (top, "topk", np.where(np.abs(M) >= least, M, 0))):
        dec = codec.decode_to_rows(msg, ["batch_id"], kind=kind, axis=axis)
        plan = dec._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
        got = np.array([list(r["decoded"]) for r in dec.orderBy("row_in_batch").collect()])
        np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("axis", [0, 1])
def test_run_counts_match_numpy(spark, axis):
    rng = np.random.default_rng(3)
    M = np.maximum(rng.normal(size=(37, 5)), 0)
    b = _batch(spark, M.tolist())
    r = codec.run_counts(codec.batch_matrix(b, "e", axis=axis)).first()
    assert (r["nnz"], r["heads"], r["tails"]) == fit.run_stats(M, axis)


def test_fp16_edges(spark):
    vals = [0.0, 1.0, 65504.0, 65519.0, 65520.0, -70000.0, 2.0 ** -25, 2.0 ** -24, 1e-8, 0.1, 3.14159,
            float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fp16_round(F.col("x"))).collect()]
    want = np.array(vals).astype(np.float16).astype(np.float64)
    for g, w in zip(got, want):
        if math.isnan(w):
            assert math.isnan(g)
        else:
            assert g == w


def test_q8_error_bound_and_constant(spark):
    rng = np.random.default_rng(1)
    M = np.maximum(rng.normal(size=(20, 4)), 0)
    b = _batch(spark, M.tolist())
    mat = codec.batch_matrix(b, "e").withColumn("orig", F.col("flat"))
    r = codec.q_embed_decode(codec.q_embed_encode(mat, 256), 256).first()
    err = np.abs(np.array(r["decoded"]) - np.array(r["orig"])).max()
    assert err <= r["scale"] / 255 + 1e-12
    g = codec.q_grad_encode(codec.batch_matrix(_batch(spark, [[2, 2], [2, 2]]), "e"), 256)
    gr = codec.q_grad_decode(g, 256).first()
    assert set(gr["codes"]) == {0} and set(gr["decoded"]) == {2.0}


def test_q4_clamps_maximum(spark):
    b = _batch(spark, [[1.0, 0.5], [0.25, 0.0]])
    r = codec.q_embed_encode(codec.batch_matrix(b, "e"), 16).first()
    assert max(r["codes"]) == 15


def test_topk_keeps_k_and_breaks_ties_by_position(spark):
    rows = [[1, -1], [1, 0.5]]
    b = _batch(spark, rows)
    r = codec.topk_encode(codec.batch_matrix(b, "e", axis=0), 2).first()
    assert list(r["idx"]) == [2, 1]           # equal magnitudes: larger position first
    r = codec.topk_encode(codec.batch_matrix(b, "e", axis=0), 10).first()
    assert len(r["idx"]) == 4


def test_masked_gradient_lossless_under_relu(spark):
    rng = np.random.default_rng(5)
    pre = rng.normal(size=(16, 4))
    E = np.maximum(pre, 0)
    G = rng.normal(size=(16, 4))
    dec = fit.encode_decode_grad(G, E, "svfl", 0)
    # the party's weight gradient only needs G where relu'(pre) = 1
    np.testing.assert_allclose(dec * (pre > 0), G.astype(np.float32) * (pre > 0))


def test_size_formulas():
    assert fit.message_bits_np("org", "emb", 1024, 8) == 32 * 1024 * 8
    nnz, H, T = 100, 10, 9
    q2 = (1024 * 8 - 1).bit_length()
    assert fit.message_bits_np("svfl16", "emb", 1024, 8, nnz, H, T) == 16 * nnz + (H + T) * q2 + 10 + 3
    assert fit.message_bits_np("svfl", "grad", 1024, 8, nnz, H, T) == 32 * nnz + 10 + 3
    assert fit.message_bits_np("topk", "grad", 4, 2, k=1024) == 8 * 3 + 8 * 32 + 2 + 1
    assert fit.message_bits_np("org", "emb", 1, 1) == 32   # one-row batch: q0 = 0


def test_dispatch_gradient_codecs(spark):
    E = [[1.0, 0.0], [0.0, 2.0], [3.0, 0.0]]
    G = [[0.5, -0.1], [0.2, -0.7], [0.05, 0.9]]
    b = spark.createDataFrame([(0, i, 3, E[i], G[i]) for i in range(3)],
                              "batch_id long, row_in_batch int, batch_rows int, e array<double>, g array<double>")
    mat = codec.batch_matrix(b, {"eflat": ("e", "row_in_batch"), "flat": ("g", "row_in_batch")})
    m = codec.encode(mat, "svfl", "grad", emb_flat="eflat").first()
    assert [round(v, 6) for v in m["vals"]] == [0.5, 0.05, -0.7]     # column-major, only where e != 0
    t = codec.encode(codec.batch_matrix(b, "g", axis=0), "topk", "grad", k=2, axis=0).first()
    assert list(t["idx"]) == [5, 3]
    rows = codec.decode(codec.encode(codec.batch_matrix(b, "g"), "q16", "grad"), "q16", ["batch_id"]) \
        .orderBy("row_in_batch").collect()
    np.testing.assert_allclose([list(r["decoded"]) for r in rows], np.array(G).astype(np.float16), rtol=0)


@pytest.mark.parametrize("axis", [0, 1])
@pytest.mark.parametrize("name", codec.CODECS)
def test_gradients_come_back_in_place(spark, name, axis):
    """Every codec's gradient decodes to the sent matrix: masked by the embedding for svfl, whole for the others."""
    rng = np.random.default_rng(21)
    E = np.maximum(rng.normal(size=(7, 3)), 0)
    G = rng.normal(size=(7, 3))
    b = spark.createDataFrame([(0, i, 7, E[i].tolist(), G[i].tolist()) for i in range(7)],
                              "batch_id long, row_in_batch int, batch_rows int, e array<double>, g array<double>")
    mat = codec.batch_matrix(b, {"eflat": ("e", "row_in_batch"), "flat": ("g", "row_in_batch")}, axis=axis)
    sent = codec.encode(mat, name, "grad", k=100, emb_flat="eflat", axis=axis)
    kept = codec.rle_encode(codec.batch_matrix(b, "e", axis=axis))
    rows = codec.decode(sent, name, ["batch_id"], "grad", axis=axis, positions=kept).orderBy("row_in_batch").collect()
    got = np.array([list(r["decoded"]) for r in rows])
    want = G * (E != 0) if name.startswith("svfl") else G
    step = {"q8": np.ptp(G) / 255, "q4": np.ptp(G) / 15}.get(name, 0) * 1.1
    np.testing.assert_allclose(got, want, rtol=1e-3 if "16" in name else 1e-6, atol=max(step, 1e-6))


def test_svfl_gradient_needs_the_kept_positions(spark):
    b = _batch(spark, [[1.0, 2.0]])
    with pytest.raises(ValueError, match="kept positions"):
        codec.decode(codec.batch_matrix(b, "e").withColumn("vals", F.col("flat")), "svfl", ["batch_id"], "grad")


def test_q8_gradient_error_bound(spark):
    rng = np.random.default_rng(12)
    G = rng.normal(size=(30, 4))
    b = _batch(spark, G.tolist())
    mat = codec.batch_matrix(b, "e").withColumn("orig", F.col("flat"))
    r = codec.q_grad_decode(codec.q_grad_encode(mat, 256), 256).first()
    err = np.abs(np.array(r["decoded"]) - np.array(r["orig"])).max()
    assert err <= (r["hi"] - r["lo"]) / 255 + 1e-12


def test_nan_counts_as_nonzero_in_runs(spark):
    rows = [[0.0, float("nan")], [0.0, 0.0]]
    r = codec.rle_encode(codec.batch_matrix(_batch(spark, rows), "e", axis=1)).first()
    assert list(r["head"]) == [2] and list(r["tail"]) == [3] and len(r["vals"]) == 1
    assert math.isnan(r["vals"][0])
