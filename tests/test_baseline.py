"""

Each configuration of the reference (split sizes, interface dims, batch 1024,
200 epochs, 3 parties) is run through the same operators the queries use:
batches from ``assign_batches`` (W3), message sizes from
``codec.message_bytes`` (A8), totals from ``evaluate.comm_totals`` (A9).
"""

import pytest
from pyspark.sql import functions as F

from partyframe.operators import codec, evaluate
from partyframe.operators.index import assign_batches

EPOCHS, PARTIES, BATCH = 200, 3, 1024

CONFIGS = {
    "census": dict(tr=29_304, va=3_257, dims=8, dense=1_187_808_000, messages=37_200, oneshot=3_125_856),
    "wine": dict(tr=5_197, va=650, dims=4, dense=106_022_400, messages=7_800, oneshot=280_656),
    "covtype": dict(tr=464_809, va=58_101, dims=4, dense=9_482_102_400, messages=579_000, oneshot=25_099_680),
}


def _messages(spark, n_tr, n_va, dims, codec_name):
    """One row per message of ONE epoch: train batches both ways, validation batches sent only."""
    def batches(n, split):
        b = assign_batches(spark.range(n).withColumnRenamed("id", "uid"), ["uid"], BATCH)
        return b.groupBy("batch_id").agg(F.max("batch_rows").alias("S")).withColumn("split", F.lit(split))
    per_batch = batches(n_tr, "tr").unionByName(batches(n_va, "va"))
    parts = F.array(*[F.lit(p) for p in range(PARTIES)])
    dirs = F.when(F.col("split") == "tr", F.array(F.lit("send"), F.lit("receive"))).otherwise(F.array(F.lit("send")))
    msgs = per_batch.select("S", "split", F.explode(parts).alias("party")).select(
        "S", "party", F.explode(dirs).alias("direction"))
    # dense codecs: the size does not depend on the values, so emb and grad formulas agree
    return msgs.withColumn("bytes", codec.message_bytes(codec_name, "emb", F.col("S"), F.lit(dims)))


@pytest.mark.parametrize("name", sorted(CONFIGS))
def test_dense_totals_match_baseline(spark, name):
    c = CONFIGS[name]
    totals = evaluate.comm_totals(_messages(spark, c["tr"], c["va"], c["dims"], "org"))
    grand = totals.filter(F.col("party").isNull() & F.col("direction").isNull()).first()
    assert grand["bytes"] * EPOCHS == c["dense"]
    assert grand["messages"] * EPOCHS == c["messages"]
    for codec_name, frac in (("q16", 2), ("q8", 4)):
        g = evaluate.comm_totals(_messages(spark, c["tr"], c["va"], c["dims"], codec_name)).filter(
            F.col("party").isNull() & F.col("direction").isNull()).first()
        assert g["bytes"] * EPOCHS * frac == c["dense"]


@pytest.mark.parametrize("name", sorted(CONFIGS))
def test_oneshot_totals_match_baseline(name):
    from partyframe.plans.fit_queries import _oneshot_bytes
    c = CONFIGS[name]
    rows = _oneshot_bytes({"tr": c["tr"], "va": c["va"], "te": 10 ** 6}, [c["dims"]] * PARTIES, 32)
    assert sum(v for t, _, v in rows if t.startswith("total/send")) == c["oneshot"]
