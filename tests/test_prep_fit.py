"""Preparation edge cases (P-ops, A1-A3) and fits against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from partyframe.operators import align, compress, fit, prep


def test_onehot_unknown_and_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("zz",)], "c string")
    cats = prep.fit_categories(df.limit(2), ["c"])["c"]
    got = [r[0] for r in df.select(prep.onehot("c", cats)).collect()]
    assert got[0] == [1.0, 0.0] and got[3] == [0.0, 0.0] and got[2] == [0.0, 0.0]


def test_a_million_categories_by_joins(spark):
    df = spark.range(2_000_000).selectExpr("id", "concat('c', pmod(id * 7919, 1000000)) AS c")
    table = prep.category_table(df, ["c"])
    assert prep.category_sizes(table, ["c", "none"]) == {"c": 1_000_000, "none": 0}
    row = table.agg({"idx": "min", "value": "min"}).first(), table.agg({"idx": "max", "value": "max"}).first()
    assert [tuple(r) for r in row] in ([(0, "c0"), (999_999, "c999999")], [("c0", 0), ("c999999", 999_999)])
    placed = prep.category_index(df.filter("id < 1000").unionByName(spark.sql("SELECT -1L id, 'zz' c")), ["c"], table)
    got = placed.selectExpr("count(*) n", "count(c_idx) held", "count(distinct c_idx) kinds").first()
    assert tuple(got) == (1001, 1000, 1000)                     # a value that the table lacks has no index


def test_sparse_row_is_the_dense_one(spark):
    df = spark.createDataFrame([(0, 0.5, "b", None), (1, None, "zz", "y"), (2, float("nan"), None, "x"), (3, 0.0, "a", "y")],
                               "id int, n double, c string, d string")
    fit_rows = df.filter("id <> 1")
    table = prep.category_table(fit_rows, ["c", "d"])
    sizes = prep.category_sizes(table, ["c", "d"])
    assert sizes == {"c": 3, "d": 3}                             # a, b, missing; missing, x, y
    placed = prep.category_index(df, ["c", "d"], table)
    parts = [(F.lit(0), F.col("n"), 1), (F.col("c_idx"), None, 3), (F.col("d_idx"), None, 3)]
    got = {r["id"]: r["f"] for r in placed.select("id", prep.sparse_row(parts).alias("f")).collect()}
    cats = prep.fit_categories(fit_rows, ["c", "d"])
    dense = {r["id"]: r["x"] for r in df.select("id", F.concat(
        F.array(F.coalesce(F.nanvl("n", F.lit(0.0)), F.lit(0.0))), prep.onehot("c", cats["c"]),
        prep.onehot("d", cats["d"])).alias("x")).collect()}
    for i, f in got.items():
        x = [0.0] * f["size"]
        for at, v in zip(f["indices"], f["values"]):
            x[at] = v
        assert x == dense[i] and all(f["values"])
    joined = {r["id"]: r["x"] for r in placed.select("id", prep.onehot_at("c_idx", 3).alias("x")).collect()}
    assert all(joined[i] == dense[i][1:4] for i in joined)


def test_empty_dictionary_and_second_category(spark):
    none = spark.createDataFrame([], "c string")
    table = prep.category_table(none, ["c"])
    assert table.count() == 0 and prep.category_sizes(table, ["c"]) == {"c": 0}
    one = spark.createDataFrame([("p",), ("p",)], "c string")
    assert prep.category_index(one, ["c"], table).select(prep.onehot_at("c_idx", 0).alias("x")).first()["x"] == []
    two = spark.createDataFrame([("q",), ("p",), ("r",)], "c string")
    assert [one.select(prep.second_category(one, "c")).first()[0], two.select(prep.second_category(two, "c")).first()[0]] \
        == [None, "q"]


def test_class_weights_of_absent_classes_and_many(spark):
    labels = spark.createDataFrame([(0,), (0,), (2,), (5,)], "y int")
    assert align.class_weight_list(labels, 4) == [2.0, None, 4.0, None]
    got = {r["y"]: r["weight"] for r in align.with_class_weight(
        spark.createDataFrame([(0,), (1,), (None,), (5,)], "y int"), labels).collect()}
    assert got == {0: 2.0, 1: None, None: None, 5: 4.0}
    many = spark.range(200_000).selectExpr("cast(pmod(id, 50000) AS int) y")
    assert align.with_class_weight(many, many).agg(F.min("weight"), F.max("weight"), F.count("weight")).first() == \
        (50_000.0, 50_000.0, 200_000)


def test_fit_table_and_minmax_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, "y"), (float("nan"), 5.0, None)],
                               "a double, k double, c string")
    f = prep.fit_table(df, ["a", "k"], ["c"])
    assert f["ranges"]["a"] == (1.0, 3.0) and f["categories"]["c"] == ["missing", "x", "y"]
    lo, hi = f["ranges"]["k"]
    assert [r[0] for r in df.select(prep.minmax("k", lo, hi)).collect()] == [0.0, 0.0, 0.0]


def test_impute_and_parse(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,)], "t string")
    assert [r["t"] for r in prep.non_numeric(df, "t").collect()] == ["abc"]
    d = df.select(prep.to_double("t").alias("x"))
    m = prep.fit_means(d, ["x"])
    assert [r["x"] for r in prep.impute_mean(d, m).collect()] == [1.5, 1.5, 1.5]


def test_align_left_zero_fill(spark):
    p0 = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "uid long, f array<double>")
    p1 = spark.createDataFrame([(1, [None, 3.0])], "uid long, f array<double>")
    r = {x["uid"]: x for x in align.align_parties([(p0, 1), (p1, 2)]).collect()}
    assert r[1]["x1"] == [0.0, 3.0] and r[2]["x1"] == [0.0, 0.0]


def _batch_pdf(rng, n=32, widths=(3, 2)):
    d = {f"x{p}": [rng.normal(size=w) for _ in range(n)] for p, w in enumerate(widths)}
    d["y"] = (rng.random(n) < 0.4).astype(int)
    d["cls"] = rng.integers(0, 3, n)
    d["uid"] = np.arange(n)
    d["batch_id"] = np.zeros(n, dtype=int)
    return pd.DataFrame(d)


def _loss(pdf, P, cfg):
    _, _, E, ecat, _, _, z = fit.joint_forward(pdf, P, cfg)
    w, l = fit.row_losses(z, pdf, cfg)
    pen = 0.0
    if cfg.lam:
        parts = np.split(ecat, np.cumsum(cfg.dims)[:-1], axis=1)   # decoded embeddings
        pen = sum(cfg.lam / cfg.divisor * np.abs(e).sum(axis=1).mean() for e in parts)
    return (w * l).sum() / w.sum() + pen


def _check_grad(cfg, seed=0):
    rng = np.random.default_rng(seed)
    pdf = _batch_pdf(rng, widths=tuple(cfg.in_sizes))
    P = {k: v + rng.normal(scale=0.3, size=v.shape) for k, v in fit.joint_params(cfg, 1).items()}
    flat = fit.Flat(P)
    g = fit.joint_batch(pdf, P, cfg, flat)[:flat.size]
    theta = flat.pack(P)
    num = np.zeros_like(theta)
    h = 1e-6
    for i in range(theta.size):
        a, b = theta.copy(), theta.copy()
        a[i] += h
        b[i] -= h
        num[i] = (_loss(pdf, flat.unpack(a), cfg) - _loss(pdf, flat.unpack(b), cfg)) / (2 * h)
    np.testing.assert_allclose(g, num, rtol=1e-4, atol=1e-6)


def test_joint_gradient_binary_matches_finite_differences():
    _check_grad(fit.JointConfig(in_sizes=[3, 2], dims=[3, 2], n_out=1, act="elu", codec=None, pos_weight=1.7))


def test_joint_gradient_multiclass_with_penalty():
    _check_grad(fit.JointConfig(in_sizes=[3, 2], dims=[2, 2], n_out=3, act="mish", codec=None, lam=0.1,
                                class_weights=[1.0, 2.0, 0.5]))


def test_autoencoder_gradient():
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x0": [rng.normal(size=6) for _ in range(20)]})
    P = {k: v + rng.normal(scale=0.3, size=v.shape) for k, v in fit.ae_params(6, 2, 0).items()}
    flat = fit.Flat(P)
    g = fit.ae_batch(pdf, P, "x0", 6, flat)[:flat.size]
    theta = flat.pack(P)
    x = np.stack(pdf["x0"].to_numpy())

    def loss(t):
        _, acts = fit.ae_forward(x, flat.unpack(t))
        return ((acts[-1] - x) ** 2).mean()
    num = np.array([(loss(theta + e) - loss(theta - e)) / 2e-6 for e in np.eye(theta.size) * 1e-6])
    np.testing.assert_allclose(g, num, rtol=1e-4, atol=1e-7)


def test_pca_matches_numpy_svd(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(200)], "id long, v array<double>")
    mean, pc = compress.pca_fit(df, "v", 3)
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    ref = vt[:3].T
    for j in range(3):
        i = np.argmax(np.abs(ref[:, j]))
        ref[:, j] *= np.sign(ref[i, j])
    np.testing.assert_allclose(pc, ref, atol=1e-8)
    codes = np.array([r["c"] for r in df.orderBy("id").select(compress.pca_codes("v", mean, pc).alias("c")).collect()])
    np.testing.assert_allclose(codes, Xc @ ref, atol=1e-8)


def test_moments_merge_over_tasks(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(301, 4)) * [1e-3, 1.0, 5.0, 0.0] + [1e6, -3.0, 1e4, 7.0]       # large means, a constant
    rows = [(X[i].tolist(),) for i in range(301)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(7)
    want = np.cov(X.T)
    for r in compress.moments(df, "v").collect():
        assert r["n"] == 301 and abs(r["mean_i"] - X[:, r["i"]].mean()) <= 1e-9 * abs(X[:, r["i"]].mean())
        np.testing.assert_allclose(r["cov"], want[r["i"], r["j"]], rtol=1e-6, atol=1e-9)
    assert compress.moments(df.filter("v IS NULL"), "v").count() == 0
    mean, pc, values = compress.pca_model(df, "v", 2)
    assert abs(values.sum() - np.trace(want)) < 1e-8 and compress.pca_residuals(df, "v", mean, pc, values).filter(
        "residual > 1e-6").count() == 0
    wrong = pc[:, ::-1].copy()                                    # exchanged components are no match for their values
    assert compress.pca_residuals(df, "v", mean, wrong, values).filter("residual > 1e-3").count() > 0


def test_fit_loss_falls(spark):
    rng = np.random.default_rng(9)
    n = 600
    x0 = rng.normal(size=(n, 3))
    x1 = rng.normal(size=(n, 2))
    y = ((x0[:, 0] + x1[:, 1]) > 0).astype(int)
    rows = [(i, x0[i].tolist(), x1[i].tolist(), int(y[i]), 0, i // 100) for i in range(n)]
    df = spark.createDataFrame(rows, "uid long, x0 array<double>, x1 array<double>, y int, cls int, batch_id long")
    tr = fit.prepare_batches(df, 4)
    cfg = fit.JointConfig(in_sizes=[3, 2], dims=[2, 2], codec="svfl16", lam=0.01)
    res = fit.fit_joint(tr, tr, None, cfg, epochs=15, lr=0.05)
    losses = [v for t, _, v in res.metrics if t == "tr/loss"]
    auc = [v for t, _, v in res.metrics if t == "va/auc"]
    assert losses[-1] < losses[0] and auc[-1] > 0.75


def test_fit_per_batch_steps_and_snapshot(spark, tmp_path):
    from partyframe.sources import io
    rng = np.random.default_rng(11)
    n = 300
    x0 = rng.normal(size=(n, 2))
    y = (x0[:, 0] > 0).astype(int)
    rows = [(i, x0[i].tolist(), int(y[i]), 0, i // 100) for i in range(n)]
    df = spark.createDataFrame(rows, "uid long, x0 array<double>, y int, cls int, batch_id long")
    tr = fit.prepare_batches(df, 3)
    cfg = fit.JointConfig(in_sizes=[2], dims=[2], codec="q8")
    path = str(tmp_path / "params")
    saved = []

    def snap(P, epoch):
        io.write_params(spark, P, "t", epoch, path)
        saved.append(epoch)
    res = fit.fit_joint(tr, tr, None, cfg, epochs=3, lr=0.05, step="batch", snapshot=snap)
    assert saved and saved[-1] == res.best_epoch
    shapes = {k: v.shape for k, v in res.params.items()}
    back = io.read_params(spark, path, "t", res.best_epoch, shapes)
    for k in shapes:
        np.testing.assert_allclose(back[k], res.params[k])
    # 3 training batches (one message each way) + 3 validation batches (sent only), one party
    counts = [v for t, _, v in res.metrics if t == "stat_count/epoch_count_all"]
    assert counts[0] == 9.0
    # q8: every message is 8 bits per cell; 300 rows x 2 dims, twice for training, once for validation
    sizes = [v for t, _, v in res.metrics if t == "stat_size/epoch_size_all"]
    assert sizes[0] == 3 * 300 * 2


def test_oneshot_codec_one_scale_per_split(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 2.0])], "uid long, c array<double>")
    got = {r["uid"]: r["c"] for r in compress.oneshot_codec(df, ["c"], "q8").collect()}
    # scale = 2.0 over the whole split: codes floor(v / 2 * 255)
    assert got[2] == [np.float32(63 * 2.0 / 255), 2.0] and got[1][1] == np.float32(127 * 2.0 / 255)
    got = {r["uid"]: r["c"] for r in compress.oneshot_codec(df, ["c"], "q16").collect()}
    assert got[1] == [0.0, 1.0]


def test_run_record_from_fit(spark, tmp_path):
    from partyframe.sources import io
    rng = np.random.default_rng(13)
    n = 200
    x0 = rng.normal(size=(n, 2))
    y = (x0[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, x0[i].tolist(), int(y[i]), 0, i // 100) for i in range(n)],
                               "uid long, x0 array<double>, y int, cls int, batch_id long")
    tr = fit.prepare_batches(df, 2)
    cfg = fit.JointConfig(in_sizes=[2], dims=[2], codec="svfl16", lam=0.01)
    res = fit.fit_joint(tr, tr, tr, cfg, epochs=2, lr=0.05)
    rec = fit.run_record(spark, "r1", cfg, res, batch_size=100, n_epochs=2)
    r = rec.first()
    assert r["total_size_all"] == r["total_size_send_0"] + r["total_size_receive_0"] > 0
    assert r["top_k"] is None and r["norm"] == 1 and 0 <= r["te_score"] <= 1
    out = io.append_run_log(spark, rec, str(tmp_path / "runs"), 1)
    assert spark.read.parquet(out).count() == 1


def test_epoch_plan_shuffles_no_rows(spark):
    rows = [(i, [float(i), 1.0], i % 2, 0, i // 10) for i in range(100)]
    df = spark.createDataFrame(rows, "uid long, x0 array<double>, y int, cls int, batch_id long")
    tr = fit.prepare_batches(df, 4)
    tr.count()
    cfg = fit.JointConfig(in_sizes=[2], dims=[2])
    P = fit.joint_params(cfg)
    flat = fit.Flat(P)
    f = fit.batch_vector_frame(tr, lambda pdf: fit.joint_batch(pdf, P, cfg, flat))
    f.collect()
    plan = f._jdf.queryExecution().executedPlan().toString()
    above_cache = plan.split("InMemoryRelation")[0]
    # the only exchange above the cached rows is the model-sized one on k
    assert above_cache.count("Exchange hashpartitioning") == 1 and "hashpartitioning(k#" in above_cache
    tr.unpersist()


def test_epochs_read_the_cached_batches_without_a_sort(spark):
    """Batches are sorted once, when cached; an epoch hands the tasks only the columns it reads."""
    df = spark.range(40).select(F.col("id").alias("uid"), (F.col("id") % 5).alias("batch_id"), F.lit("unread").alias("s"),
                                F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x0"))
    tr = fit.prepare_batches(df, 3)
    assert tr.count() == 40
    f = fit.batch_vector_frame(tr.select("batch_id", "x0"),
                               lambda t: np.append(fit._x(t, "x0", 2).sum(axis=0), t.num_columns))
    plan = f._jdf.queryExecution().executedPlan().toString()
    top = plan[plan.rindex("FlatMapGroupsIn"):]
    assert "Sort " not in top[:top.index("InMemoryTableScan")]
    assert {r["k"]: r["v"] for r in f.collect()} == {0: sum(range(40)), 1: 40.0, 2: 10.0}
    tr.unpersist()
