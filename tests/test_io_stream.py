"""Round trips of the sources / sinks (S1-S10, U2) and the streaming tracker."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partyframe.sources import io, tables
from partyframe.streaming.monitor import follow_metric_log


def test_headerless_csv_with_banner_keeps_leading_blank(spark, tmp_path):
    p = tmp_path / "adult.test"
    p.write_text("|1x3 Cross validator\n25, Private, <=50K.\n38, ?, >50K.\n")
    st = T.StructType([T.StructField("age", T.LongType()), T.StructField("workclass", T.StringType()),
                       T.StructField("over_50k", T.StringType())])
    df = tables.read_csv_no_header(spark, str(p), st, banner_prefix="|")
    rows = df.collect()
    assert [r["workclass"] for r in rows] == [" Private", " ?"]
    from partyframe.operators.prep import first_part
    assert [r[0] for r in df.select(first_part("over_50k")).collect()] == [" <=50K", " >50K"]


def test_header_csv_semicolon_and_names(spark, tmp_path):
    p = tmp_path / "red.csv"
    p.write_text('"fixed acidity";"pH";"quality"\n7.4;3.51;5\n7.8;3.2;7\n')
    df = tables.normalise_names(tables.read_csv_header(spark, str(p), sep=";"))
    df = tables.with_source(df, "color", 0)
    assert df.columns == ["fixed_acidity", "ph", "quality", "color"]
    assert df.count() == 2


def test_party_dataset_roundtrip_and_partition_filter(spark, tmp_path):
    df = spark.createDataFrame([(1, "tr", [1.0, 2.0]), (2, "te", [3.0, 4.0])],
                               "uid long, split string, features array<double>")
    io.write_party_dataset(df, str(tmp_path), 0)
    back = io.read_party_dataset(spark, str(tmp_path), 0, "te")
    assert [r["uid"] for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()
    arr = io.read_party_arrays(spark, str(tmp_path), 1)
    assert arr.schema["features"].dataType.simpleString() == "array<float>"


def test_messages_metrics_runlog_params(spark, tmp_path):
    msgs = spark.createDataFrame([("tr", 0, 0, 2, [1.0], [0], [1])],
                                 "split string, party int, batch_id long, samples int, vals array<float>, "
                                 "head array<int>, tail array<int>")
    io.write_messages(msgs, str(tmp_path / "m"))
    assert io.read_messages(spark, str(tmp_path / "m"), "tr", 0).count() == 1
    io.append_metrics(spark, [("r", "va/auc", 0, 0.5)], str(tmp_path / "met"))
    io.append_metrics(spark, [("r", "va/auc", 1, 0.6)], str(tmp_path / "met"))
    assert spark.read.parquet(str(tmp_path / "met")).count() == 2
    a = spark.createDataFrame([("r1", 10)], "run_id string, top_k int")
    b = spark.createDataFrame([("r2", "pca")], "run_id string, compress string")
    v1 = io.append_run_log(spark, a, str(tmp_path / "runs"), 1)
    v2 = io.append_run_log(spark, b, str(tmp_path / "runs"), 2)
    log = {r["run_id"]: r for r in spark.read.parquet(v2).collect()}
    assert log["r1"]["compress"] is None and log["r2"]["top_k"] is None and v1 != v2
    io.export_tsv(spark.read.parquet(v2), str(tmp_path / "runs.tsv"))
    P = {"w": np.arange(6.0).reshape(3, 2), "b": np.array([1.0, 2.0])}
    io.write_params(spark, P, "r1", 3, str(tmp_path / "params"))
    back = io.read_params(spark, str(tmp_path / "params"), "r1", 3, {"w": (3, 2), "b": (2,)})
    np.testing.assert_array_equal(back["w"], P["w"])
    np.testing.assert_array_equal(back["b"], P["b"])


def test_run_log_never_loses_rows(spark, tmp_path):
    base = str(tmp_path / "log")
    row = lambda name: spark.createDataFrame([(name, 1)], "run_id string, k int")
    io.append_run_log(spark, row("a"), base, 1)
    io.append_run_log(spark, row("b"), base, 2)
    v4 = io.append_run_log(spark, row("c"), base, 4)                    # version 3 was never written
    assert {r["run_id"] for r in spark.read.parquet(v4).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="not above"):
        io.append_run_log(spark, row("d"), base, 4)
    with pytest.raises(TypeError, match="k"):
        io.append_run_log(spark, spark.createDataFrame([("e", "x")], "run_id string, k string"), base, 5)
    (tmp_path / "log" / "v=6").mkdir()                                  # a version that cannot be read
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        io.append_run_log(spark, row("f"), base, 7)
    assert io.log_versions(spark, base) == [1, 2, 4, 6]


def test_concurrent_appends_are_all_kept(spark, tmp_path):
    base = str(tmp_path / "log")
    names = [f"r{i}" for i in range(6)]
    with ThreadPoolExecutor(max_workers=6) as pool:
        out = list(pool.map(lambda n: io.append_run_log(spark, spark.createDataFrame([(n,)], "run_id string"), base),
                            names))
    assert sorted(out) == [f"{base}/v={i}" for i in range(1, 7)]
    assert sorted(r["run_id"] for r in spark.read.parquet(f"{base}/v=6").collect()) == names
    assert not [p for p in (tmp_path / "log").rglob("_aside*")]


def test_a_writer_that_lost_reads_again(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "log")
    row = lambda name: spark.createDataFrame([(name,)], "run_id string")
    io.append_run_log(spark, row("a"), base)
    listed, stale = io.log_versions, [[1]]
    io.append_run_log(spark, row("b"), base)
    monkeypatch.setattr(io, "log_versions", lambda *a: stale.pop() if stale else listed(*a))
    v3 = io.append_run_log(spark, row("c"), base)                       # listed before b was there
    assert v3.endswith("v=3") and {r["run_id"] for r in spark.read.parquet(v3).collect()} == {"a", "b", "c"}
    stale.append([1])
    with pytest.raises(ValueError, match="not above"):                  # a version asked for by number is not changed
        io.append_run_log(spark, row("d"), base, 2)
    assert {r["run_id"] for r in spark.read.parquet(f"{base}/v=2").collect()} == {"a", "b"}
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["v=1", "v=2", "v=3"]


def test_streaming_tracker_matches_batch_rule(spark, tmp_path):
    path = str(tmp_path / "metrics")
    scores = [0.5, 0.6, 0.6, 0.55, 0.58, 0.7]
    io.append_metrics(spark, [("r", "va/auc", i, s) for i, s in enumerate(scores[:3])], path)
    ck = str(tmp_path / "ck")
    out = str(tmp_path / "tracked")
    follow_metric_log(spark, path, "va/auc", ck, patience=2, output_path=out).awaitTermination(120)
    first = spark.read.parquet(out).orderBy("micro_batch").collect()
    assert first[-1]["best_epoch"] == 1 and first[-1]["waiting"] == 1
    # a restarted tracker resumes from the checkpointed state
    io.append_metrics(spark, [("r", "va/auc", i, s) for i, s in enumerate(scores) if i >= 3], path)
    follow_metric_log(spark, path, "va/auc", ck, patience=2, output_path=out).awaitTermination(120)
    last = spark.read.parquet(out).orderBy("micro_batch").collect()[-1]
    # waits 1, 2, 3 > 2 at epoch 4: stopped there; epoch 5 comes too late
    assert last["stop_epoch"] == 4 and last["best_epoch"] == 1 and last["last_epoch"] == 5


def test_prepare_vertical_writes_party_datasets(spark, tmp_path):
    from partyframe.plans.prepare import PrepSpec, prepare_vertical, write_vertical
    rows = [(i, float(i), ["a", "b", "c"][i % 3], " >50K" if i % 4 == 0 else " <=50K") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x double, c string, lab string")
    spec = PrepSpec(numeric=["x"], categorical=["c"], parties=[["x"], ["c"]], label="lab", order_by=["k"],
                    fit_on="train")
    parties, labels, fitted = prepare_vertical(df, spec)
    assert fitted["categories"]["lab"] == [" <=50K", " >50K"]          # second in sorted order = positive
    lo, hi = fitted["ranges"]["x"]
    tr_x = [r["k"] for r in parties.filter("split = 'tr' AND party = 0").join(
        df.withColumnRenamed("k", "uid"), "uid").select("uid").withColumnRenamed("uid", "k").collect()]
    assert lo == min(tr_x) and hi == max(tr_x)                        # fitted on training rows only
    write_vertical(parties, labels, str(tmp_path), 2)
    p1 = io.read_party_dataset(spark, str(tmp_path), 1, "te").collect()
    assert len(p1) == 4 and all(len(r["features"]) == 3 for r in p1)
    ys = {r["uid"]: r["y"] for r in spark.read.parquet(str(tmp_path / "labels")).collect()}
    assert sum(ys.values()) == 10


def test_end_to_end_prepare_then_runs(spark, tmp_path):
    """Entry 1 -> Entry 2 and Entry 3, through files, as a user of the reference runs them."""
    import numpy as np
    from partyframe.plans.experiment import run_oneshot, run_vfl
    from partyframe.plans.prepare import PrepSpec, prepare_vertical, write_vertical
    rng = np.random.default_rng(21)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    cat = np.where(a + b > 0, "hi", np.where(a > 0, "mid", "lo"))
    lab = np.where(a + 0.5 * b > 0, "yes", "no")
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), str(cat[i]), str(lab[i])) for i in range(n)],
                               "k long, a double, b double, c string, lab string")
    spec = PrepSpec(numeric=["a", "b"], categorical=["c"], parties=[["a"], ["b", "c"]], label="lab",
                    order_by=["k"])
    parties, labels, _ = prepare_vertical(df, spec)
    write_vertical(parties, labels, str(tmp_path / "data"), 2)
    metrics, record = run_vfl(spark, str(tmp_path / "data"), [1, 4], [2, 2], run_id="svfl", codec="svfl16",
                              lam=0.01, batch_size=64, epochs=8, lr=0.05,
                              snapshot_path=str(tmp_path / "params"), metrics_path=str(tmp_path / "live"))
    # the streaming tracker over the live metric log agrees with the fit's best epoch
    follow_metric_log(spark, str(tmp_path / "live"), "va/auc", str(tmp_path / "ck"),
                      output_path=str(tmp_path / "tracked")).awaitTermination(120)
    tracked = spark.read.parquet(str(tmp_path / "tracked")).orderBy("micro_batch").collect()[-1]
    assert tracked["best_epoch"] == record.first()["best_epoch"] and tracked["last_epoch"] == 7
    r = record.first()
    assert r["te_score"] > 0.7 and r["total_size_send_0"] > 0 and r["total_size_receive_1"] > 0
    assert metrics.filter("tag = 'va/auc'").count() == 8
    assert spark.read.parquet(str(tmp_path / "params")).filter("run_id = 'svfl'").count() > 0
    m2, rec2 = run_oneshot(spark, str(tmp_path / "data"), [1, 4], [1, 2], run_id="pca", compress_with="pca",
                           batch_size=64, epochs=5, lr=0.05)
    r2 = rec2.first()
    assert r2["total_size_receive_0"] == 0 and r2["total_size_send_1"] > 0
    log = io.append_run_log(spark, rec2, str(tmp_path / "runs"),
                            int(io.append_run_log(spark, record, str(tmp_path / "runs"), 1).split("=")[-1]) + 1)
    assert spark.read.parquet(log).count() == 2
    # a small grid (two codecs and a one-shot run), two runs at a time, appended as version 3
    from partyframe.plans.experiment import run_grid
    grid = [dict(run_id="q8", codec="q8", dims=[2, 2], batch_size=64, epochs=2, lr=0.05),
            dict(run_id="topk", codec="topk", top_k=16, dims=[2, 2], batch_size=64, epochs=2, lr=0.05),
            dict(run_id="ae", compress_with="ae", codec="q8", dims=[1, 2], batch_size=64, epochs=2,
                 ae_epochs=2, lr=0.05)]
    v3 = run_grid(spark, str(tmp_path / "data"), [1, 4], grid, str(tmp_path / "runs"), 3, concurrent=2)
    runs = {r["run_id"]: r for r in spark.read.parquet(v3).collect()}
    assert set(runs) == {"svfl", "pca", "q8", "topk", "ae"}
    assert runs["topk"]["top_k"] == 16 and runs["q8"]["top_k"] is None and runs["ae"]["compress"] == "ae"
    # q8 sends one byte per cell: (2 x train + validation) rows x 2 dims per party and epoch;
    # 400 rows split 324 / 36 / 40 (test ceil(10 %), validation ceil(10 % of the rest))
    assert runs["q8"]["total_size_send_0"] + runs["q8"]["total_size_receive_0"] == 2 * (2 * 324 + 36) * 2


def test_numbers_with_leading_blank_parse_like_pandas(spark, tmp_path):
    p = tmp_path / "adult.data"
    p.write_text("39, State-gov, 77516, <=50K\n50, ?, 83311, >50K\n")
    st = T.StructType([T.StructField("age", T.LongType()), T.StructField("workclass", T.StringType()),
                       T.StructField("fnlwgt", T.LongType()), T.StructField("over_50k", T.StringType())])
    rows = tables.read_csv_no_header(spark, str(p), st).collect()
    assert [r["fnlwgt"] for r in rows] == [77516, 83311] and rows[1]["workclass"] == " ?"


def _census_line(rng, i, label):
    wc = ["Private", "State-gov", "?"][i % 3]
    return (f"{20 + i % 50}, {wc}, {1000 + i}, Bachelors, 13, Never-married, Sales, Husband, White, "
            f"{['Male', 'Female'][i % 2]}, 0, 0, 40, United-States, {label}")


def test_census_preset_end_to_end(spark, tmp_path):
    import numpy as np
    from partyframe.plans.datasets import census_spec, read_census
    from partyframe.plans.prepare import prepare_vertical
    rng = np.random.default_rng(1)
    (tmp_path / "adult.data").write_text("\n".join(_census_line(rng, i, "<=50K" if i % 3 else ">50K")
                                                   for i in range(60)) + "\n")
    (tmp_path / "adult.test").write_text("|1x3 Cross validator\n" + "\n".join(
        _census_line(rng, i, "<=50K." if i % 2 else ">50K.") for i in range(20)) + "\n")
    df = read_census(spark, str(tmp_path / "adult.data"), str(tmp_path / "adult.test"))
    parties, labels, fitted = prepare_vertical(df, census_spec())
    sizes = {r["split"]: r["count"] for r in labels.groupBy("split").count().collect()}
    assert sizes == {"tr": 54, "va": 6, "te": 20}
    assert fitted["categories"]["over_50k"] == [" <=50K", " >50K"]     # test labels lost their '.'
    assert fitted["categories"]["workclass"] == [" ?", " Private", " State-gov"]
    ids = sorted(r["uid"] for r in labels.collect())
    assert ids == list(range(80))                                      # test ids continue after train
    assert {r["uid"] for r in labels.filter("split = 'te'").collect()} == set(range(60, 80))
    widths = {r["party"]: len(r["features"]) for r in parties.select("party", "features").distinct().collect()}
    assert widths == {0: 1 + 3 + 1 + 1 + 1, 1: 1 + 1 + 1 + 1 + 2, 2: 3 + 1}
    assert labels.filter("split = 'te'").agg(F.sum("y")).first()[0] == 10


def test_wine_and_covtype_presets(spark, tmp_path):
    from partyframe.plans.datasets import WINE_NUMERIC, read_covtype, read_wine, covtype_spec, wine_spec
    from partyframe.plans.prepare import prepare_vertical
    head = '"fixed acidity";"volatile acidity";"citric acid";"residual sugar";"chlorides";' \
           '"free sulfur dioxide";"total sulfur dioxide";"density";"pH";"sulphates";"alcohol";"quality"'
    for name, n in (("red", 30), ("white", 50)):
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "\n".join(
            ";".join(str(0.1 * (i + j)) for j in range(11)) + f";{3 + i % 6}" for i in range(n)) + "\n")
    wine = read_wine(spark, str(tmp_path / "red.csv"), str(tmp_path / "white.csv"))
    parties, labels, _ = prepare_vertical(wine, wine_spec())
    sizes = {r["split"]: r["count"] for r in labels.groupBy("split").count().collect()}
    assert sizes == {"tr": 64, "va": 8, "te": 8}
    assert labels.agg(F.sum("y")).first()[0] == sum(1 for n in (30, 50) for i in range(n) if 3 + i % 6 >= 7)
    assert sorted(len(r["features"]) for r in parties.select("party", "features").limit(200).collect())[0] == 4
    rows = [",".join(str((i + j) % 5) for j in range(54)) + f",{1 + i % 7}" for i in range(40)]
    (tmp_path / "covtype.data").write_text("\n".join(rows) + "\n")
    cov = read_covtype(spark, str(tmp_path / "covtype.data"))
    parties, labels, _ = prepare_vertical(cov, covtype_spec())
    assert sorted(r["y"] for r in labels.select("y").distinct().collect()) == list(range(7))
    widths = {r["party"]: len(r["features"]) for r in parties.select("party", "features").distinct().collect()}
    assert widths == {0: 7, 1: 7, 2: 40}


def test_only_the_banner_line_is_skipped(spark, tmp_path):
    from pyspark.sql import types as T

    from partyframe.sources import tables
    (tmp_path / "t.csv").write_text("|a banner line\n|x, 1\n y, 2\n|z, 3\n")
    st = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())])
    rows = tables.read_csv_no_header(spark, str(tmp_path / "t.csv"), st, banner_prefix="|").collect()
    assert [(r["s"], r["n"]) for r in rows] == [("|x", 1), (" y", 2), ("|z", 3)]


def test_wine_reader_fills_with_the_mean(spark, tmp_path):
    from partyframe.plans import datasets
    names = [c for c in datasets.WINE_NUMERIC if c != "color"]
    head = ";".join(f'"{c.replace("_", " ")}"' for c in names) + ';"quality"'
    line = lambda x: ";".join([str(x)] * len(names) + ["7"])
    (tmp_path / "r.csv").write_text(f"{head}\n{line(1.0)}\n{line(3.0)}\n")
    (tmp_path / "w.csv").write_text(f"{head}\n{line('?')}\n")
    rows = datasets.read_wine(spark, str(tmp_path / "r.csv"), str(tmp_path / "w.csv")).collect()
    assert sorted(r["ph"] for r in rows) == [1.0, 2.0, 3.0] and sorted(r["color"] for r in rows) == [0.0, 0.0, 1.0]


def test_parties_can_be_chosen(spark, tmp_path):
    from partyframe.plans.experiment import load_aligned
    from partyframe.plans.prepare import write_vertical
    parties = spark.createDataFrame([(u, "tr", p, [float(10 * p + u)]) for u in range(3) for p in range(3)],
                                    "uid long, split string, party int, features array<double>")
    labels = spark.createDataFrame([(u, "tr", u % 2) for u in range(3)], "uid long, split string, y int")
    write_vertical(parties, labels, str(tmp_path / "d"), 3)
    got = {r["uid"]: (r["x0"], r["x1"], r["y"]) for r in load_aligned(spark, str(tmp_path / "d"), [1, 1], [0, 2]).collect()}
    assert got == {u: ([float(u)], [20.0 + u], u % 2) for u in range(3)}
