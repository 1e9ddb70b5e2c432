"""Packed messages: exact round trips, exact sizes, storage by split and party."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.operators import codec, payload
from partyframe.operators.index import assign_batches
from partyframe.sources import io


def _matrix(spark, axis=1):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(75):
        e = np.maximum(rng.normal(size=7), 0) * (rng.random(7) < 0.7)
        e[0] = [0.0, 70000.0, 1e-9, e[0]][i % 4]
        rows.append((i, e.astype(np.float32).tolist(), rng.normal(size=7).astype(np.float32).tolist()))
    df = assign_batches(spark.createDataFrame(rows, "uid long, e array<float>, g array<float>"), ["uid"], 16)
    return codec.batch_matrix(df, {"flat": ("e", "row_in_batch"), "gflat": ("g", "row_in_batch")}, axis=axis)


def _encoded(mat, c, d, axis=1):
    src, emb = ("flat", None) if d == "emb" else ("gflat", "flat")
    counted = mat.withColumn("nnz", F.size(codec.nonzero_values(F.col("flat")))).withColumn(
        "heads", F.size(codec.run_heads(F.col("flat")))).withColumn("tails", F.size(codec.run_tails(F.col("flat"))))
    return codec.encode(counted, c, d, k=20, flat=src, emb_flat=emb, axis=axis)


@pytest.mark.parametrize("axis", [0, 1])
def test_unpack_gives_back_every_message(spark, axis):
    mat = _matrix(spark, axis).cache()
    for c in codec.CODECS:
        for d in ("emb", "grad"):
            m = _encoded(mat, c, d, axis)
            cols = ["samples", "dims", *payload.message_columns(c, d)]
            size = codec.message_bytes(c, d, "samples", "dims", "nnz", "heads", "tails", k=20)
            sent = m.select("batch_id", size.alias("bytes"), *cols, payload.payload(c, d).alias("payload")).collect()
            back = {r["batch_id"]: r for r in payload.unpack(
                m.select("batch_id", payload.payload(c, d).alias("payload")), c, d).collect()}
            assert len(back) == len(sent) == 5
            for r in sent:
                assert all(back[r["batch_id"]][x] == r[x] for x in cols), (c, d)
                assert len(r["payload"]) == r["bytes"] + payload.header_bytes(c, d), (c, d)


def test_edge_messages():
    one = dict(vals=np.array([2.5], np.float32), head=[0], tail=[])
    for parts, s, n in ((one, 1, 1), (dict(vals=[], head=[], tail=[]), 3, 2), (dict(vals=[np.nan, np.inf], head=[0, 4], tail=[1, 5]), 2, 3)):
        for c in ("svfl", "svfl16"):
            data = payload.pack_message(c, "emb", s, n, parts)
            got = payload.unpack_message(data)
            assert (got["samples"], got["dims"], got["head"].tolist(), got["tail"].tolist()) == (s, n, parts["head"], parts["tail"])
            assert np.array_equal(got["vals"], np.array(parts["vals"], np.float32), equal_nan=True)
    data = payload.pack_message("q4", "emb", 3, 1, dict(codes=[15, 0, 7], scale=1.5))
    assert data[-2:] == bytes([0xF0, 0x70]) and payload.unpack_message(data)["codes"].tolist() == [15, 0, 7]


def test_stored_bytes_are_read_back_and_decoded(spark, tmp_path):
    """Write by split and party, read one partition, decode to the rows that were sent."""
    mat = _matrix(spark).cache()
    sent = _encoded(mat, "svfl", "emb").select("batch_id", payload.payload("svfl").alias("payload"))
    for split, party in (("tr", 0), ("tr", 1), ("va", 0)):
        io.write_messages(sent.withColumn("split", F.lit(split)).withColumn("party", F.lit(party)), f"{tmp_path}/m")
    read = io.read_messages(spark, f"{tmp_path}/m", "tr", 1)
    assert read.count() == 5 and "PartitionFilters: [isnotnull" in read._jdf.queryExecution().toString()
    got = codec.decode(payload.unpack(read.select("batch_id", "payload"), "svfl"), "svfl", ["batch_id"]).collect()
    want = {r["batch_id"]: np.array(r["flat"]).reshape(r["dims"], r["samples"]).T for r in mat.collect()}
    assert len(got) == 75
    assert all(np.array_equal(np.array(r["decoded"], np.float32), want[r["batch_id"]][r["row_in_batch"]].astype(np.float32)) for r in got)
    with pytest.raises(Exception, match="not of q8"):
        payload.unpack(sent, "q8").collect()
