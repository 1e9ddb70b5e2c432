"""Dense index, splits, batches (W1-W3) and evaluation (E1, E2, W7, W8) against brute force."""

import contextlib
import itertools

import numpy as np
from pyspark.sql import functions as F

from partyframe.operators import evaluate
from partyframe.operators.index import (assign_batches, dense_index, md5_order_key, running_sum,
                                        seeded_split, shuffled_batches)


@contextlib.contextmanager
def many_partitions(spark):
    """Small tables would be coalesced into one partition; offsets matter only with several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def test_dense_index_many_buckets_equals_global_order(spark):
    rng = np.random.default_rng(0)
    keys = rng.permutation(5000)
    df = spark.createDataFrame([(int(k), float(k % 97)) for k in keys], "k long, s double")
    with many_partitions(spark):
        out = dense_index(df, ["s", "k"]).collect()
    got = sorted((r["idx"], r["s"], r["k"]) for r in out)
    want = sorted((s, k) for k, s in ((int(k), float(k % 97)) for k in keys))
    assert [(g[1], g[2]) for g in got] == want
    assert [g[0] for g in got] == list(range(5000))


def test_md5_order_uniform_buckets(spark):
    df = spark.range(3000).withColumnRenamed("id", "uid")
    b = shuffled_batches(df, "uid", 128, seed=3).collect()
    pdf = spark.range(3000).withColumnRenamed("id", "uid").select(
        "uid", md5_order_key(3, "uid").alias("h")).toPandas().sort_values(["h", "uid"]).reset_index(drop=True)
    pos = {u: i for i, u in enumerate(pdf["uid"])}
    for r in b:
        i = pos[r["uid"]]
        assert r["batch_id"] == i // 128 and r["row_in_batch"] == i % 128
        assert r["batch_rows"] == min(128, 3000 - (i // 128) * 128)


def test_split_sizes_exact(spark):
    df = spark.range(1001).withColumnRenamed("id", "uid")
    c = {r["split"]: r["count"] for r in seeded_split(df, "uid", (0.1, 0.1), ("tr", "va", "te")).groupBy("split")
         .count().collect()}
    te = int(np.ceil(1001 * 0.1))
    va = int(np.ceil((1001 - te) * 0.1))
    assert c == {"te": te, "va": va, "tr": 1001 - te - va}


def test_batches_in_key_order(spark):
    df = spark.range(10).withColumnRenamed("id", "uid")
    r = assign_batches(df, ["uid"], 4).orderBy("uid").collect()
    assert [x["batch_id"] for x in r] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert [x["batch_rows"] for x in r][-1] == 2


def test_running_sum(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "k long, v double")
    with many_partitions(spark):
        got = {r["k"]: r["below"] for r in running_sum(df, ["k"], "v").collect()}
    acc = 0.0
    for i in range(300):
        assert got[i] == acc
        acc += i % 3


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(400), 1)          # many ties
    y = (rng.random(400) < 0.4).astype(int)
    df = spark.createDataFrame([(float(a), int(b), int(i % 2)) for i, (a, b) in enumerate(zip(s, y))],
                               "p double, y int, g int")
    got = {r["g"]: r["auc"] for r in evaluate.auc(df, "p", "y", by=("g",)).collect()}
    for g in (0, 1):
        idx = np.arange(400) % 2 == g
        assert abs(got[g] - _auc_brute(list(s[idx]), list(y[idx]))) < 1e-12


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert evaluate.auc(df, "p", "y").first()["auc"] is None


def test_macro_f1_matches_manual(spark):
    truth = [0, 0, 1, 1, 2, 2, 2]
    pred = [0, 1, 1, 1, 0, 2, 3]          # class 3 only predicted: F1 0
    df = spark.createDataFrame(list(zip(truth, pred)), "t int, p int")
    got = evaluate.macro_f1(df, "t", "p").first()
    f1 = []
    for c in sorted(set(truth) | set(pred)):
        tp = sum(1 for a, b in zip(truth, pred) if a == b == c)
        f1.append(2 * tp / (truth.count(c) + pred.count(c)))
    assert abs(got["macro_f1"] - np.mean(f1)) < 1e-12 and got["classes"] == 4


def test_best_epoch_and_early_stop(spark):
    scores = [0.5, 0.6, 0.6, 0.55, 0.58, 0.7, 0.69]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "run_id string, epoch int, score double")
    b = evaluate.best_epoch(df).first()
    assert b["best_epoch"] == 5 and b["improvements"] == 3       # equal score at epoch 2 is no improvement
    e = evaluate.early_stop(df, patience=2).first()
    # waits: e2=1, e3=2, e4=3 > 2 -> stop at epoch 4; best within = epoch 1
    assert e["stop_epoch"] == 4 and e["epochs_run"] == 5 and e["best_epoch"] == 1
    e = evaluate.early_stop(df, patience=5).first()
    assert e["stop_epoch"] is None and e["best_epoch"] == 5


def test_hot_first_key_is_split_and_order_kept(spark):
    """One value of the first order column holds 40 % of the rows: it is split on the second
    column over several partitions, and the index still equals the global order."""
    from partyframe.operators.index import PART, _dealt
    rng = np.random.default_rng(8)
    n = 6000
    k1 = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, n))
    k2 = rng.permutation(n)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(k1, k2)], "k1 long, k2 long")
    with many_partitions(spark):
        dealt = _dealt(df, [], ["k1", "k2"])
        per = {r[PART]: r["count"] for r in dealt.filter("k1 = 7").groupBy(PART).count().collect()}
        assert len(per) >= 3 and max(per.values()) < 0.2 * n
        out = dense_index(df, ["k1", "k2"]).collect()
    got = sorted((r["idx"], r["k1"], r["k2"]) for r in out)
    want = sorted(zip(k1.tolist(), k2.tolist()))
    assert [(g[1], g[2]) for g in got] == want and [g[0] for g in got] == list(range(n))


def test_holdout_split_sizes(spark):
    df = spark.range(6497).withColumnRenamed("id", "uid")       # red + white wine rows
    c = {r["split"]: r["count"] for r in seeded_split(df, "uid", (0.2, 0.5), ("tr", "va", "te"), holdout=True)
         .groupBy("split").count().collect()}
    held = int(np.ceil(6497 * 0.2))
    te = int(np.ceil(held * 0.5))
    assert c == {"tr": 6497 - held, "va": held - te, "te": te} == {"tr": 5197, "va": 650, "te": 650}


def test_nan_scores_never_count(spark):
    nan = float("nan")
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate([0.6, nan, 0.9, nan])],
                               "run_id string, epoch int, score double")
    b = evaluate.best_epoch(df).first()
    assert (b["best_epoch"], b["best_score"], b["improvements"]) == (2, 0.9, 2)
    e = evaluate.early_stop(df, patience=0).first()
    assert e["stop_epoch"] == 1 and e["best_epoch"] == 0
    down = evaluate.best_epoch(df, higher_is_better=False).first()
    assert down["best_epoch"] == 0 and down["best_score"] == 0.6


def test_alignment_fills_nan_and_refuses_a_double_uid(spark):
    import pytest

    from partyframe.operators import align
    a = spark.createDataFrame([(1, [1.0, float("nan"), None]), (2, [2.0, 0.0, 1.0])], "uid long, x array<double>")
    b = spark.createDataFrame([(1, [5.0])], "uid long, x array<double>")
    got = {r["uid"]: (r["x0"], r["x1"]) for r in align.align_parties([(a, 3), (b, 1)]).collect()}
    assert got == {1: ([1.0, 0.0, 0.0], [5.0]), 2: ([2.0, 0.0, 1.0], [0.0])}
    with pytest.raises(Exception, match="occurs twice"):
        align.align_parties([(a, 3), (b.unionByName(b), 1)]).collect()


def _exchanges(df, column):
    """Exchanges of the main plan (no subqueries) whose rows carry a column."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.initialPlan())
            continue
        out = [node.output().apply(i).name() for i in range(node.output().size())]
        if name == "ShuffleExchangeExec" and column in out:
            found.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_numbering_is_lazy_and_moves_rows_once(spark):
    """No job while the query is built, no checkpoint, one exchange of the rows' own columns."""
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("g"), F.rand(1).alias("wide"))
    sc = spark.sparkContext
    for build in (lambda: dense_index(df, ["g", "id"]), lambda: assign_batches(df, ["id"], 64, partition_by=["g"]),
                  lambda: seeded_split(df, "id", (0.1, 0.1), ("a", "b", "c")), lambda: shuffled_batches(df, "id", 64)):
        sc.setJobGroup("build", "build")
        out = build()
        assert list(sc.statusTracker().getJobIdsForGroup("build")) == []
        sc.setJobGroup("other", "other")
        plan = out._jdf.queryExecution().toString()
        assert "ExistingRDD" not in plan and "Checkpoint" not in plan
        assert len(_exchanges(out, "wide")) == 1
        assert out.count() == 2000


def test_index_per_group_with_null_and_hot_keys(spark):
    """Null groups and keys, a first key that a third of the rows hold, more ranges than rows, no rows."""
    rows = [(None if i % 5 == 0 else i % 3, 7 if i % 3 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, hot long, k long")
    with many_partitions(spark):
        got = dense_index(df, ["hot", "k"], total="n", partition_by=["g"]).collect()
        few = dense_index(df.limit(3), ["hot", "k"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["hot"], r["k"]) for r in got if r["g"] == g)
        assert [(r["hot"], r["k"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["idx"])] == mine
        assert sorted(r["idx"] for r in got if r["g"] == g) == list(range(len(mine)))
        assert {r["n"] for r in got if r["g"] == g} == {len(mine)}
    assert sorted(r["idx"] for r in few) == [0, 1, 2]
    assert dense_index(df.limit(0), ["hot", "k"]).count() == 0
    assert seeded_split(df.limit(0), "k").count() == 0


def test_splitters_even_out_a_skewed_order(spark):
    """Exponential keys: no range holds more than a few times the mean."""
    from partyframe.operators import index
    df = spark.range(20_000).select(F.exp(F.col("id") / 900).alias("v"), "id")
    ranged = index._ranged(df, [], ["v", "id"], None)
    sizes = [r["count"] for r in ranged.groupBy(index.PART).count().collect()]
    assert len(sizes) == index.n_ranges(df) and max(sizes) < 2.5 * 20_000 / len(sizes)


def test_alignment_is_one_exchange(spark):
    from partyframe.operators import align
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (None, [3.0]), (None, [3.0])], "uid long, f array<double>")
    b = spark.createDataFrame([(2, [5.0, None]), (9, [1.0, 1.0]), (None, [7.0, 7.0])], "uid long, f array<double>")
    c = spark.createDataFrame([(1, [float("nan")])], "uid long, f array<double>")
    out = align.align_parties([(a, 1), (b, 2), (c, 1)])
    assert len(_exchanges(out, "uid")) == 1 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["uid"], r["x0"], r["x1"], r["x2"]) for r in out.collect()), key=str)
    assert got == sorted([(1, [1.0], [0.0, 0.0], [0.0]), (2, [2.0], [5.0, 0.0], [0.0]),
                          (None, [3.0], [0.0, 0.0], [0.0]), (None, [3.0], [0.0, 0.0], [0.0])], key=str)
