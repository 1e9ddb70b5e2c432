"""Party datasets, messages, metric / run logs and parameter snapshots.

Everything is Parquet under a folder the caller names (on a cluster: shared
storage).  Writes never overwrite a folder that the same job reads: appends
go through Parquet's own ``append`` mode, and the run log is written aside and
renamed to a new version folder.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "run_id string, tag string, step int, value double"
PARAM_SCHEMA = "run_id string, epoch int, layer string, r int, row array<double>"


# ------------------------------------------------------------------ S4, S5, S6

def write_party_dataset(df: DataFrame, path: str, party: int, mode: str = "overwrite") -> None:
    """One party's ``(uid, split, features)`` under ``path/party=<p>/split=<s>``."""
    (df.select("uid", "split", F.col(df.columns[-1] if "features" not in df.columns else "features")
               .alias("features"))
     .write.mode(mode).partitionBy("split").parquet(f"{path.rstrip('/')}/party={party}"))


def write_labels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("uid", "split", "y").write.mode(mode).partitionBy("split").parquet(f"{path.rstrip('/')}/labels")


def read_party_dataset(spark: SparkSession, path: str, party: int, split: str | None = None) -> DataFrame:
    """Read back one party; the ``split`` filter prunes partitions (only that folder is listed)."""
    df = spark.read.parquet(f"{path.rstrip('/')}/party={party}")
    return df.filter(F.col("split") == split) if split else df


def read_party_arrays(spark: SparkSession, path: str, n_parties: int, split: str | None = None) -> DataFrame:
    """Every party as ``(uid, party, features ARRAY<FLOAT>)`` in one frame."""
    frames = []
    for p in range(n_parties):
        d = read_party_dataset(spark, path, p, split)
        frames.append(d.select("uid", F.lit(p).alias("party"), F.col("features").cast("array<float>")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------------ S7

def write_messages(msgs: DataFrame, path: str, mode: str = "append") -> None:
    """Encoded messages, one row per (split, party, batch), partitioned by (split, party)."""
    msgs.write.mode(mode).partitionBy("split", "party").parquet(path)


def write_counted_messages(msgs: DataFrame, path: str, parties: list[int], bytes_col: str = "bytes",
                           mode: str = "append") -> dict[int, dict[str, int]]:
    """A9 while S7 is written: per party the messages, bytes and rows (``samples``) that this write stored.

    The sums are observed on the rows as they pass to the files, so nothing is encoded or read twice.  They cover
    ``parties``; a message of another party, or a null size, is an error after the write.
    """
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("all"), F.count(bytes_col).alias("sized")]
    for p in parties:
        mine = F.col("party") == p
        sums += [F.count_if(mine).alias(f"messages_{p}"),
                 F.coalesce(F.sum(F.when(mine, F.col(bytes_col))), F.lit(0)).cast("long").alias(f"bytes_{p}"),
                 F.coalesce(F.sum(F.when(mine, F.col("samples"))), F.lit(0)).cast("long").alias(f"rows_{p}")]
    write_messages(msgs.observe(seen, *sums), path, mode)
    got = seen.get
    if got["all"] != sum(got[f"messages_{p}"] for p in parties) or got["all"] != got["sized"]:
        raise ValueError(f"messages of other parties than {parties}, or without {bytes_col}")
    return {p: {c: got[f"{c}_{p}"] for c in ("messages", "bytes", "rows")} for p in parties}


def read_messages(spark: SparkSession, path: str, split: str, party: int) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("split") == split) & (F.col("party") == party))


# ------------------------------------------------------------------ S8, S9, U2

def append_metrics(spark: SparkSession, rows: list | DataFrame, path: str) -> None:
    """Append ``(run_id, tag, step, value)`` rows."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, METRIC_SCHEMA)
    df.write.mode("append").parquet(path)


def append_run_log(spark: SparkSession, new_runs: DataFrame, base: str, version: int | None = None) -> str:
    """Union the latest log version with ``new_runs`` by name (missing columns null)
    into a new folder ``base/v=<version>``; returns that folder.

    The latest version is found by listing ``base``; only an empty or absent
    ``base`` starts a new log.  A version that cannot be read is an error, and
    so is a column whose type differs; nothing is ever overwritten.

    Several writers may append at once.  Each writes its version aside and
    renames it, which fails where that version has come to exist.  Without
    ``version`` (the next one), a writer that lost reads the log again and
    tries the version after it, so that the log keeps the rows of both; with ``version``, which must be above
    all others, it gets an error.  The rename must be atomic in the store, as it is
    in HDFS and on local disks.
    """
    while True:
        have = log_versions(spark, base)
        take = version if version is not None else (have[-1] + 1 if have else 1)
        if have and take <= have[-1]:
            raise ValueError(f"version {take} is not above the latest one, {have[-1]}")
        merged = new_runs
        if have:
            old = spark.read.parquet(f"{base.rstrip('/')}/v={have[-1]}")
            types = dict(old.dtypes)
            clash = [c for c, t in new_runs.dtypes if types.get(c, t) != t]
            if clash:
                raise TypeError(f"columns with another type than in the log: {clash}")
            merged = old.unionByName(new_runs, allowMissingColumns=True)
        if _commit(spark, merged, base, take):
            return f"{base.rstrip('/')}/v={take}"


def _commit(spark: SparkSession, df: DataFrame, base: str, version: int) -> bool:
    """Write aside, then rename to ``v=<version>`` unless that is there; false where another writer was first.

    The folder holds a file named for its writer.  Stores that move a folder into one of the same name instead
    of refusing (local disks, if two writers rename in the same instant) leave it one level too deep; that
    writer takes it back and has lost.
    """
    base, name = base.rstrip("/"), f"_aside-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside, final = hadoop.Path(f"{base}/{name}"), hadoop.Path(f"{base}/v={version}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(aside.toString())
    fs.create(hadoop.Path(aside, f"_writer{name}")).close()
    try:
        if not fs.exists(final):
            fs.rename(aside, final)
        won = fs.exists(hadoop.Path(final, f"_writer{name}"))
    finally:
        fs.delete(aside, True)
        fs.delete(hadoop.Path(final, name), True)
    return won


def log_versions(spark: SparkSession, base: str) -> list[int]:
    """Version numbers below ``base``, in order (through Hadoop's file system, so any store will do)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def export_tsv(df: DataFrame, path: str) -> None:
    """The run log as tab-separated text with a header (the reference's file format)."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


# ------------------------------------------------------------------ S10

def params_frame(spark: SparkSession, params: dict[str, np.ndarray], run_id: str, epoch: int) -> DataFrame:
    """A parameter snapshot as rows ``(run_id, epoch, layer, r, row)`` (model-sized)."""
    rows = []
    for layer, arr in params.items():
        a = np.atleast_2d(np.asarray(arr, dtype=float))
        if np.asarray(arr).ndim == 1:
            a = a.reshape(1, -1)
        for r, row in enumerate(a):
            rows.append((run_id, int(epoch), layer, r, [float(v) for v in row]))
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def write_params(spark: SparkSession, params: dict, run_id: str, epoch: int, path: str) -> None:
    params_frame(spark, params, run_id, epoch).write.mode("append").partitionBy("run_id").parquet(path)


def read_params(spark: SparkSession, path: str, run_id: str, epoch: int, shapes: dict) -> dict[str, np.ndarray]:
    """Load a snapshot; ``shapes`` gives each layer's shape (1-d layers are stored as one row)."""
    rows = (spark.read.parquet(path).filter((F.col("run_id") == run_id) & (F.col("epoch") == epoch))
            .select("layer", "r", "row").collect())
    out = {}
    for layer, shape in shapes.items():
        rr = sorted((x for x in rows if x["layer"] == layer), key=lambda x: x["r"])
        a = np.array([list(x["row"]) for x in rr])
        out[layer] = a.reshape(shape)
    return out
