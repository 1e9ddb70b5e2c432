"""Fitting queries over the star schema (M12-M19) and PCA codes of ``embeddings``.

These are iterative (a few Spark jobs per epoch), so they have no SQL twin;
the driver's check is rows-only and pytest checks them against numpy.
Each returns metric rows ``(run_id, tag, step, value)`` (S8) built from the
model-sized results of the Spark jobs.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from partyframe.functions.numeric import round6
from partyframe.operators import align, compress, fit
from partyframe.operators.index import assign_batches, seeded_split, shuffled_batches
from partyframe.plans.model_queries import BATCH, DIM, LAMBDA, SEED
from partyframe.plans.registry import register
from partyframe.plans.star import WIDTHS, aligned, build_star
from partyframe.sources.tables import read_table

# fixed values: test-query parameters
SPLIT_SEED = 7
FIT_EPOCHS = 3
FIT_LR = 0.01
PCA_K = 4
PCA_CODEC = "org"        # PCA codes are signed: the reference's grids send them unquantised
AE_CODEC = "q8"          # autoencoder codes follow a ReLU, so one max-scale fits them
ONESHOT_BITS = {"org": 32, "q16": 16, "q8": 8, "q4": 4}
METRIC_SCHEMA = "run_id string, tag string, step int, value double"


def star_split_batches(spark, sf_dir, batch: int = BATCH):
    """(star, split frame, tr, va, te): train batches in a seeded permutation, validation and
    test batches in uid order; each hash-partitioned on batch_id and cached."""
    star = build_star(spark, sf_dir)
    sp = aligned(star, seeded_split(star.labels, "uid", (0.1, 0.1), ("tr", "va", "te"), seed=SPLIT_SEED)).persist()
    tr = fit.prepare_batches(shuffled_batches(sp.filter(F.col("split") == "tr"), "uid", batch, seed=SEED))
    va, te = (fit.prepare_batches(assign_batches(sp.filter(F.col("split") == name), ["uid"], batch))
              for name in ("va", "te"))
    return star, sp, tr, va, te


def _release(*frames):
    for f in frames:
        f.unpersist()


def _metrics_frame(spark, run_id: str, metrics):
    rows = [(run_id, tag, int(step), float(v)) for tag, step, v in metrics]
    return spark.createDataFrame(rows, METRIC_SCHEMA)


# ------------------------------------------------------------------ M16

@register("pca_codes")
def pca_codes_q(spark, sf_dir):
    """Embeddings centred and projected on their first 4 principal components
    (distributed covariance; sign fixed so the largest loading is positive)."""
    emb = read_table(spark, sf_dir, "embeddings")
    mean, pc = compress.pca_fit(emb, "embedding", PCA_K)
    codes = compress.pca_codes("embedding", mean, pc)
    return emb.select("vec_id", F.transform(codes, lambda v: F.round(v, 6)).alias("codes"))


@register("pca_check", """
WITH c AS (SELECT unnest(range(0, len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
d AS (SELECT dim, avg(x) AS m, var_samp(x) AS v FROM c GROUP BY dim)
SELECT dim, round(m, 6) AS mean, round(v, 6) AS variance, round((SELECT sum(v) FROM d), 6) AS total_variance,
       0.0::DOUBLE AS residual
FROM d
""")
def pca_check(spark, sf_dir):
    """M16 measured on the rows: per column mean and variance, the sum of all eigenvalues (the total
    variance) and the largest distance of the covariance times a loading from eigenvalue times loading."""
    emb = read_table(spark, sf_dir, "embeddings").select("embedding")
    mean, pc, values = compress.pca_model(emb, "embedding", PCA_K)
    found = compress.pca_residuals(emb, "embedding", mean, pc, values)
    return found.select("dim", round6(F.col("mean")).alias("mean"), round6(F.col("variance")).alias("variance"),
                        round6(F.lit(float(values.sum()))).alias("total_variance"),
                        round6(F.col("residual")).alias("residual"))


# ------------------------------------------------------------------ M12-M15

@register("fit_joint")
def fit_joint_q(spark, sf_dir):
    """Joint fit of three party layers (ReLU, 4 wide) and the head, svfl16 codec on
    both directions, L1 penalty; validation AUC per epoch, test AUC with the best snapshot."""
    star, sp, tr, va, te = star_split_batches(spark, sf_dir)
    pw = align.pos_weight(tr).first()["pos_weight"]
    cfg = fit.JointConfig(in_sizes=list(WIDTHS), dims=[DIM] * 3, n_out=1, act="relu", codec="svfl16",
                          lam=LAMBDA, pos_weight=pw)
    res = fit.fit_joint(tr, va, te, cfg, epochs=FIT_EPOCHS, lr=FIT_LR, seed=SEED)
    metrics = res.metrics + [(f"total/{k}", res.best_epoch, v) for k, v in res.totals.items()]
    _release(sp, tr, va, te)
    return _metrics_frame(spark, "joint_svfl16", metrics)


# ------------------------------------------------------------------ M19

def _oneshot_bytes(split_sizes: dict, dims: list[int], bits: int) -> list:
    """Training and validation codes sent once as dense rows x dims matrices; nothing comes back.
    (Test codes are encoded for scoring but, as in the reference, not counted.)"""
    out = []
    for p, d in enumerate(dims):
        total = sum(math.ceil(split_sizes.get(s, 0) * d * bits / 8) for s in ("tr", "va"))
        out.append((f"total/send_bytes_{p}", 0, float(total)))
        out.append((f"total/receive_bytes_{p}", 0, 0.0))
    return out


def _split_sizes(sp) -> dict:
    return {r["split"]: r["n"] for r in sp.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}


@register("fit_head")
def fit_head_q(spark, sf_dir):
    """M16 + M19: each party's features compressed once by PCA fitted on its training rows,
    each split's codes sent once (float32); only the head is trained on the decoded codes."""
    star, sp, tr, va, te = star_split_batches(spark, sf_dir)
    dims = [min(PCA_K, w) for w in WIDTHS]
    fits = [compress.pca_fit(tr, f"x{p}", dims[p]) for p in range(3)]

    def coded(df):
        for p, (mean, pc) in enumerate(fits):
            df = df.withColumn(f"x{p}", compress.pca_codes(f"x{p}", mean, pc))
        # each split's codes travel once through the codec (one scale per split for q8 / q4)
        return compress.oneshot_codec(df, [f"x{p}" for p in range(3)], PCA_CODEC)

    trc, vac, tec = (fit.prepare_batches(coded(d)) for d in (tr, va, te))
    pw = align.pos_weight(tr).first()["pos_weight"]
    cfg = fit.JointConfig(in_sizes=dims, dims=dims, n_out=1, codec=None, pos_weight=pw, fixed_parties=True)
    res = fit.fit_joint(trc, vac, tec, cfg, epochs=FIT_EPOCHS, lr=FIT_LR, seed=SEED)
    metrics = res.metrics + _oneshot_bytes(_split_sizes(sp), dims, ONESHOT_BITS[PCA_CODEC])
    _release(sp, tr, va, te, trc, vac, tec)
    return _metrics_frame(spark, f"pca_{PCA_CODEC}", metrics)


# ------------------------------------------------------------------ M17, M18

@register("fit_autoencoder")
def fit_autoencoder_q(spark, sf_dir):
    """M17 + M18 + M19: one autoencoder per party (in -> in/2 -> 4 -> in/2 -> in, early stop on
    validation MSE), each split's codes sent once as 8-bit codes, then the head trained on the
    decoded codes (3-class, weighted CE)."""
    star, sp, tr, va, te = star_split_batches(spark, sf_dir)
    dims = [DIM] * 3
    metrics = []
    # each party trains its own autoencoder: independent jobs, submitted together
    with ThreadPoolExecutor(max_workers=len(WIDTHS)) as pool:
        fitted = list(pool.map(lambda pw: fit.fit_autoencoder(tr, va, f"x{pw[0]}", pw[1], dims[pw[0]],
                                                              epochs=FIT_EPOCHS, lr=FIT_LR, seed=SEED),
                               enumerate(WIDTHS)))
    aes = [P for P, _ in fitted]
    for p, (_, hist) in enumerate(fitted):
        for epoch, trl, val in hist:
            metrics += [(f"ae{p}/tr_loss", epoch, trl), (f"ae{p}/va_loss", epoch, val)]

    def coded(df):
        for p, P in enumerate(aes):
            df = fit.ae_codes(df, P, f"x{p}", WIDTHS[p], f"x{p}")
        return compress.oneshot_codec(df, [f"x{p}" for p in range(3)], AE_CODEC)

    trc, vac, tec = (fit.prepare_batches(coded(d)) for d in (tr, va, te))
    n_cls = len(star.status_categories)
    cw = align.class_weight_list(tr, n_cls, "cls")
    cfg = fit.JointConfig(in_sizes=dims, dims=dims, n_out=n_cls, codec=None, class_weights=cw,
                          fixed_parties=True)
    res = fit.fit_joint(trc, vac, tec, cfg, epochs=FIT_EPOCHS, lr=FIT_LR, seed=SEED)
    metrics += res.metrics + _oneshot_bytes(_split_sizes(sp), dims, ONESHOT_BITS[AE_CODEC])
    _release(sp, tr, va, te, trc, vac, tec)
    return _metrics_frame(spark, f"ae_{AE_CODEC}", metrics)
