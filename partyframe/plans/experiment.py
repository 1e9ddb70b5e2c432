"""Entries 2 and 3 of the reference as calls: party datasets on disk -> fitted run.

``run_vfl`` is the joint run with a codec: read every party's dataset
and the labels (S6), align them on ``uid`` with zero fill (J1, J2), batch
the training split in a seeded permutation and the others in uid order (W3),
fit with the chosen codec (M13-M15) and return the metric rows and the run
record (S8, E3).  ``run_oneshot`` is the one-shot compression run:
PCA or an autoencoder per party, codes sent once, head-only fit (M16-M19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.operators import align, compress, fit
from partyframe.operators.index import assign_batches, shuffled_batches
from partyframe.sources import io

METRIC_SCHEMA = "run_id string, tag string, step int, value double"


def load_aligned(spark: SparkSession, path: str, widths: list[int], chosen: list[int] | None = None) -> DataFrame:
    """``(uid, split, x0 .. xk, y)``: the first party drives the rows, the others are left-joined
    with zero fill, the label is joined by key.  ``chosen`` names the parties that take part
    (P15; all by default), one per entry of ``widths``; x0 is the first of them."""
    chosen = list(range(len(widths))) if chosen is None else chosen
    if len(chosen) != len(widths):
        raise ValueError("one width per chosen party")
    parties = []
    for k, (p, w) in enumerate(zip(chosen, widths)):
        d = io.read_party_dataset(spark, path, p)
        cols = ["uid", "features"] + (["split"] if k == 0 else [])
        parties.append((d.select(*cols), w))
    first, w0 = parties[0]
    al = align.align_parties([(first.select("uid", "features"), w0)] + parties[1:])
    al = al.join(first.select("uid", "split"), "uid")
    labels = spark.read.parquet(f"{path.rstrip('/')}/labels").select("uid", F.col("y").cast("int"))
    return al.join(labels, "uid").withColumn("cls", F.col("y"))


def split_batches(al: DataFrame, batch_size: int, seed: int = 0, names=("tr", "va", "te")):
    tr = fit.prepare_batches(shuffled_batches(al.filter(F.col("split") == names[0]), "uid", batch_size,
                                              seed=seed))
    others = [fit.prepare_batches(assign_batches(al.filter(F.col("split") == n), ["uid"], batch_size))
              for n in names[1:]]
    return [tr] + others


def run_vfl(spark: SparkSession, path: str, widths: list[int], dims: list[int], run_id: str = "run",
            codec: str = "svfl16", act: str = "relu", n_out: int = 1, lam: float = 0.0, norm: int = 1,
            top_k: int = 1024, batch_size: int = 1024, epochs: int = 200, lr: float = 1e-3,
            party_optimizer: str = "adam", patience: int | None = None, seed: int = 0, bias: bool = True,
            step: str = "epoch", snapshot_path: str | None = None,
            metrics_path: str | None = None, axis: int = 1,
            chosen: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The joint run, over the ``chosen`` parties (all by default). Returns (metric rows, one-row run record).  With ``metrics_path`` every
    epoch's metric rows are appended there while the run goes on (the streaming tracker can
    follow that folder)."""
    al = load_aligned(spark, path, widths, chosen)
    tr, va, te = split_batches(al, batch_size, seed)
    if n_out == 1:
        pw = align.pos_weight(tr).first()["pos_weight"]
        cw = None
    else:
        pw = 1.0
        cw = align.class_weight_list(tr, n_out, "cls")
    cfg = fit.JointConfig(in_sizes=widths, dims=dims, n_out=n_out, act=act, codec=codec, top_k=top_k, lam=lam,
                          penalty_p=norm, pos_weight=pw, class_weights=cw, bias=bias, axis=axis)
    snap = None
    if snapshot_path:
        def snap(P, epoch):
            io.write_params(spark, P, run_id, epoch, snapshot_path)
    live = None
    if metrics_path:
        def live(rows):
            io.append_metrics(spark, [(run_id, t, int(s), float(v)) for t, s, v in rows], metrics_path)
    res = fit.fit_joint(tr, va, te, cfg, epochs=epochs, lr=lr, party_optimizer=party_optimizer, seed=seed,
                        patience=patience, step=step, snapshot=snap, on_epoch=live)
    record = fit.run_record(spark, run_id, cfg, res, batch_size=batch_size, n_epochs=epochs, lr=lr,
                            seed=seed, client_optimizer=party_optimizer)
    for f in (tr, va, te):
        f.unpersist()
    metrics = spark.createDataFrame([(run_id, t, int(s), float(v)) for t, s, v in res.metrics], METRIC_SCHEMA)
    return metrics, record


def run_oneshot(spark: SparkSession, path: str, widths: list[int], dims: list[int], run_id: str = "run",
                compress_with: str = "pca", codec: str = "org", n_out: int = 1, batch_size: int = 1024,
                epochs: int = 200, lr: float = 1e-3, ae_epochs: int = 200, patience: int = 5,
                seed: int = 0, chosen: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The one-shot run, over the ``chosen`` parties (all by default): PCA (fit on training rows) or an autoencoder per party, each split's
    codes sent once through ``codec``, head-only fit. Returns (metric rows, run record)."""
    al = load_aligned(spark, path, widths, chosen)
    tr, va, te = split_batches(al, batch_size, seed)
    cols = [f"x{p}" for p in range(len(widths))]
    metrics = []
    if compress_with == "pca":
        fits = [compress.pca_fit(tr, c, min(d, w)) for c, d, w in zip(cols, dims, widths)]
        dims = [pc.shape[1] for _, pc in fits]

        def coded(df):
            for c, (mean, pc) in zip(cols, fits):
                df = df.withColumn(c, compress.pca_codes(c, mean, pc))
            return compress.oneshot_codec(df, cols, codec)
    else:
        from concurrent.futures import ThreadPoolExecutor
        # the parties' autoencoders are independent: their jobs are submitted together
        with ThreadPoolExecutor(max_workers=len(cols)) as pool:
            fitted = list(pool.map(lambda a: fit.fit_autoencoder(tr, va, a[0], a[1], a[2], epochs=ae_epochs, lr=lr,
                                                                 patience=patience, seed=seed),
                                   zip(cols, widths, dims)))
        aes = [P for P, _ in fitted]
        for p, (_, hist) in enumerate(fitted):
            metrics += [(f"ae{p}/va_loss", e, v) for e, _, v in hist]

        def coded(df):
            for c, w, P in zip(cols, widths, aes):
                df = fit.ae_codes(df, P, c, w, c)
            return compress.oneshot_codec(df, cols, codec)
    trc, vac, tec = (fit.prepare_batches(coded(d)) for d in (tr, va, te))
    pw = align.pos_weight(tr).first()["pos_weight"] if n_out == 1 else 1.0
    cw = None
    if n_out > 1:
        cw = align.class_weight_list(tr, n_out, "cls")
    cfg = fit.JointConfig(in_sizes=dims, dims=dims, n_out=n_out, codec=None, pos_weight=pw, class_weights=cw,
                          fixed_parties=True)
    res = fit.fit_joint(trc, vac, tec, cfg, epochs=epochs, lr=lr, seed=seed, patience=patience)
    # one-shot bytes: training and validation codes once (test codes are not counted)
    bits = {"org": 32, "q16": 16, "q8": 8, "q4": 4}[codec]
    sizes = {r["split"]: r["n"] for r in al.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for p, d in enumerate(dims):
        res.totals[f"send_bytes_{p}"] = float(sum(-(-sizes.get(s, 0) * d * bits // 8) for s in ("tr", "va")))
        res.totals[f"receive_bytes_{p}"] = 0.0
    record = fit.run_record(spark, run_id, cfg, res, batch_size=batch_size, n_epochs=epochs, lr=lr, seed=seed,
                            compress=compress_with, reduction=f"{compress_with}_{codec}")
    for f in (tr, va, te, trc, vac, tec):
        f.unpersist()
    rows = [(run_id, t, int(s), float(v)) for t, s, v in metrics + res.metrics]
    return spark.createDataFrame(rows, METRIC_SCHEMA), record


def run_grid(spark: SparkSession, path: str, widths: list[int], configs: list[dict], runs_dir: str,
             version: int, concurrent: int = 1) -> str:
    """Entry 4 (the experiment grid): every configuration is one run - ``run_vfl``, or
    ``run_oneshot`` when it has ``compress_with`` - and their records are unioned by name (runs
    of different kinds carry different columns) into version ``version`` of the run log.

    ``concurrent`` > 1 submits that many runs at once from driver threads, so small runs share
    the cluster instead of queueing; each run is still its own set of Spark jobs.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(cfg: dict):
        cfg = dict(cfg)
        kind = run_oneshot if "compress_with" in cfg else run_vfl
        return kind(spark, path, widths, **cfg)[1]

    with ThreadPoolExecutor(max_workers=max(1, concurrent)) as pool:
        records = list(pool.map(one, configs))
    merged = records[0]
    for r in records[1:]:
        merged = merged.unionByName(r, allowMissingColumns=True)
    return io.append_run_log(spark, merged, runs_dir, version)
