"""One-shot compression of a party's features: PCA (M16) and the codes it sends.

The fit reads the rows once: tasks fold them into moments that one aggregate
merges (:func:`moments`); the driver solves the d x d covariance.  Codes are one expression over the loading matrix as an array literal
(:func:`.model.linear`), so the plan does not grow with d x k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.operators import model

def moments(df: DataFrame, col: str) -> DataFrame:
    """Means and covariances of an array column in one pass: ``(i, j, n, mean_i, mean_j, cov)``, i <= j.

    Each task folds its batches into (count, means, centred products) and
    sends the upper triangle, d (d + 1) / 2 numbers, which one aggregate
    merges: products within tasks plus what the tasks' means differ by.
    Values are taken relative to one row, so large means cost no digits.
    Null vectors do not count; null elements make their moments NaN.
    """
    held = df.select(F.col(col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    row = held.first()
    base = np.zeros(0) if row is None else np.nan_to_num(np.array(row["v"], dtype=float))
    d = len(base)
    up_i, up_j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, prod = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d) - base
            m = x.mean(axis=0)
            x -= m
            both = n + len(x)
            gap = m - mean
            prod += x.T @ x + np.outer(gap, gap) * (n * len(x) / both)
            mean += gap * (len(x) / both)
            n = both
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(up_i, pa.int32()), pa.array(up_j, pa.int32()), pa.array(np.full(len(up_i), n), pa.int64()),
                 pa.array(mean[up_i]), pa.array(mean[up_j]), pa.array(prod[up_i, up_j])],
                names=["i", "j", "n", "a", "b", "p"])

    parts = held.mapInArrow(run, "i int, j int, n long, a double, b double, p double")
    n = F.col("n")
    sums = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("a")).alias("a"),
                                       F.sum(F.col("n") * F.col("b")).alias("b"),
                                       F.sum(F.col("n") * F.col("a") * F.col("b")).alias("ab"), F.sum("p").alias("p"))
    shift = F.lit([float(v) for v in base])
    return sums.select("i", "j", "n", (F.col("a") / n + F.get(shift, F.col("i"))).alias("mean_i"),
                       (F.col("b") / n + F.get(shift, F.col("j"))).alias("mean_j"),
                       F.when(n > 1, (F.col("p") + F.col("ab") - F.col("a") * F.col("b") / n) / (n - 1)).alias("cov"))


def pca_fit(df: DataFrame, col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (d,) and loadings (d, k); each component's largest-magnitude loading made positive."""
    mean, pc, _ = pca_model(df, col, k)
    return mean, pc


def pca_model(df: DataFrame, col: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (d,), loadings (d, k) and all d eigenvalues, descending, of the covariance of :func:`moments`.

    The driver gets the d (d + 1) / 2 merged moments; d is the width of a party's features.
    """
    rows = moments(df, col).collect()
    d = 1 + max((r["j"] for r in rows), default=-1)
    if not d or k > d:
        raise ValueError(f"{k} components of {d} columns")
    mean, cov = np.zeros(d), np.zeros((d, d))
    for r in rows:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = 0.0 if r["cov"] is None else r["cov"]
        mean[r["i"]] = r["mean_i"]
    values, vectors = np.linalg.eigh(cov)
    pc = vectors[:, ::-1][:, :k].copy()
    for j in range(k):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] = -pc[:, j]
    return mean, pc, values[::-1]


def pca_residuals(df: DataFrame, col: str, mean: np.ndarray, pc: np.ndarray, values: np.ndarray) -> DataFrame:
    """How far each loading is from an eigenvector, measured on the rows: ``(dim, mean, variance, residual)``.

    The covariance times a loading is the mean product of a centred column
    with that component's code; ``residual`` is the largest difference over
    the components from eigenvalue times loading.
    """
    k = pc.shape[1]
    rows = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("x"),
                                                    pca_codes(col, mean, pc).alias("codes"))
    cells = rows.select("codes", F.posexplode("x").alias("dim", "x"))
    centre = F.get(F.lit([float(v) for v in mean]), F.col("dim"))
    met = cells.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"),
        *[F.sum((F.col("x") - centre) * F.col("codes")[c]).alias(f"s{c}") for c in range(k)])
    want = model.matrix_literal([[float(v) for v in row] for row in pc[:, :k] * values[:k]], "array<array<double>>")
    off = [F.abs(F.col(f"s{c}") / (F.col("n") - 1) - F.get(want, F.col("dim"))[c]) for c in range(k)]
    return met.select(F.col("dim").cast("int").alias("dim"), "mean", "variance",
                      (F.greatest(*off) if k > 1 else off[0]).alias("residual"))


def pca_codes(col: str, mean: np.ndarray, pc: np.ndarray) -> Column:
    """``(x - mean) @ pc`` as an ``ARRAY<DOUBLE>``; one expression, whatever the sizes."""
    centre = model.matrix_literal([float(v) for v in mean], "array<double>")
    return model.linear(F.zip_with(F.col(col), centre, lambda v, m: v.cast("double") - m), pc, None)


def oneshot_codec(df: DataFrame, cols: list[str], codec: str) -> DataFrame:
    """The codes of one split sent once and decoded by the server.

    ``org`` keeps float32, ``q16`` rounds to fp16, ``q8`` / ``q4`` quantise with
    ONE scale per column over the whole split (its maximum), as a one-shot
    message does.  The scales come from one aggregation (one number per
    column); the rest is an array expression per row.
    """
    from partyframe.functions.numeric import fp16_round
    if codec == "org":
        return df.select(*[F.col(c) for c in df.columns if c not in cols],
                         *[F.transform(c, lambda v: v.cast("float").cast("double")).alias(c) for c in cols])
    if codec == "q16":
        return df.select(*[F.col(c) for c in df.columns if c not in cols],
                         *[F.transform(c, lambda v: fp16_round(v).cast("float").cast("double")).alias(c)
                           for c in cols])
    if codec not in ("q8", "q4"):
        raise ValueError(f"one-shot codec must be org, q16, q8 or q4, not {codec}")
    mult, top = (255.0, 255) if codec == "q8" else (16.0, 15)
    row = df.agg(*[F.max(F.array_max(c)).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        scale = float(row[c] or 0.0)
        if scale <= 0:
            out = out.withColumn(c, F.transform(c, lambda v: F.lit(0.0)))
            continue
        out = out.withColumn(c, F.transform(c, lambda v: (
            F.least(F.greatest(F.floor(v / F.lit(scale) * F.lit(mult)), F.lit(0)), F.lit(top))
            * F.lit(scale) / F.lit(mult)).cast("float").cast("double")))
    return out
