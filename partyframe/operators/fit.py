"""Joint fitting, one-shot compression and autoencoders.

Shape of every fit: the training rows carry a ``batch_id`` (W3, bounded by
``batch_size`` rows) and are hash-partitioned on it, sorted by it and cached,
once.  One epoch is ONE Spark job: ``groupBy(batch_id).applyInArrow`` over the
columns that the fit reads runs the forward
pass, the codec round trip, the loss and the closed-form backward pass of one
batch with numpy (the parameters travel in the closure - a few hundred
numbers) and returns the batch's gradient as ``(k, v)`` rows; ``groupBy(k).sum``
reduces them to one model-sized vector, which is all the driver ever sees.
The driver applies the optimiser step (Adam / SGD / RMSprop) and starts the
next epoch from the same cached table, so lineage never grows.

The step is the gradient of the epoch loss (the mean of batch-mean losses,
A11), i.e. one update per epoch instead of one per batch; state this
difference when comparing curves with a per-batch optimiser.

Codecs act inside the batch exactly as on the wire: embeddings are encoded and
decoded per batch (per-batch scales for q8 / q4), gradients likewise, the
``svfl`` gradient is masked by the embedding's non-zeros, and bytes are
counted with the size formulas of :mod:`partyframe.operators.codec`.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from partyframe.functions.numeric import ELU_ALPHA, LEAKY_SLOPE, SELU_ALPHA, SELU_SCALE, log2_ceil_py


# ------------------------------------------------------------------ numpy activations (M2)

def _softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def act_np(name: str, x: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0.0)
    if name == "leaky_relu":
        return np.where(x >= 0, x, x * LEAKY_SLOPE)
    if name == "elu":
        return np.where(x > 0, x, ELU_ALPHA * np.expm1(np.minimum(x, 0)))
    if name == "selu":
        return SELU_SCALE * np.where(x > 0, x, SELU_ALPHA * np.expm1(np.minimum(x, 0)))
    if name == "mish":
        return x * np.tanh(_softplus(x))
    return x


def act_grad_np(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if name == "relu":
        return (x > 0).astype(float)
    if name == "leaky_relu":
        return np.where(x >= 0, 1.0, LEAKY_SLOPE)
    if name == "elu":
        return np.where(x > 0, 1.0, y + ELU_ALPHA)
    if name == "selu":
        return np.where(x > 0, SELU_SCALE, y + SELU_SCALE * SELU_ALPHA)
    if name == "mish":
        t = np.tanh(_softplus(x))
        return t + x * (1 - t * t) * _sigmoid(x)
    return np.ones_like(x)


# ------------------------------------------------------------------ numpy codecs (C1-C13 inside a batch)

def fp16_np(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x.astype(np.float16).astype(np.float64)


def _levels(codec: str) -> tuple[float, int]:
    return (255.0, 255) if codec == "q8" else (16.0, 15)


def encode_decode_emb(E: np.ndarray, codec: str | None) -> np.ndarray:
    """Embedding as the server decodes it."""
    if codec is None:
        return E
    if codec in ("q16", "svfl16", "topk16"):
        return fp16_np(E)
    if codec in ("q8", "q4"):
        mult, top = _levels(codec)
        scale = float(E.max()) if E.size else 0.0
        if scale <= 0:
            return np.zeros_like(E)
        codes = np.clip(np.floor(E / scale * mult), 0, top)
        return codes * scale / mult
    return E.astype(np.float32).astype(np.float64)          # org, int, svfl, topk (RLE is lossless)


def encode_decode_grad(G: np.ndarray, E: np.ndarray, codec: str | None, k: int) -> np.ndarray:
    """Gradient as the party decodes it (``svfl*`` keeps only the embedding's non-zero positions)."""
    if codec is None:
        return G
    if codec in ("org", "int"):
        return G.astype(np.float32).astype(np.float64)
    if codec == "q16":
        return fp16_np(G)
    if codec in ("svfl", "svfl16"):
        vals = G.astype(np.float32).astype(np.float64) if codec == "svfl" else fp16_np(G)
        return np.where(E != 0, vals, 0.0)
    if codec in ("topk", "topk16"):
        flat = G.ravel()                                     # row-major positions
        n = flat.size
        keep = min(k, n)
        # ties: larger position first
        order = np.lexsort((-np.arange(n), -np.abs(flat)))[:keep]
        out = np.zeros(n)
        vals = flat[order]
        out[order] = vals.astype(np.float32) if codec == "topk" else fp16_np(vals)
        return out.reshape(G.shape)
    if codec in ("q8", "q4"):
        mult, top = _levels(codec)
        lo, hi = float(G.min()), float(G.max())
        if hi - lo <= 0:
            return np.full_like(G, lo)
        codes = np.clip(np.floor((G - lo) / (hi - lo) * mult), 0, top)
        return codes * (hi - lo) / mult + lo
    raise ValueError(f"unknown codec {codec}")


def run_stats(E: np.ndarray, axis: int = 1) -> tuple[int, int, int]:
    """nnz, heads, tails of the flattened batch (an open last run has no tail); ``axis=1``
    column-major (the default layout), ``axis=0`` row-major."""
    nz = ((E.T if axis == 1 else E).ravel() != 0)
    if nz.size == 0:
        return 0, 0, 0
    prev = np.concatenate([[False], nz[:-1]])
    return int(nz.sum()), int((nz & ~prev).sum()), int((~nz & prev).sum())


def message_bits_np(codec: str, direction: str, S: int, D: int, nnz=0, heads=0, tails=0, k=0) -> int:
    """Driver / executor twin of :func:`codec.message_bits`."""
    q0, q1, q2 = log2_ceil_py(S), log2_ceil_py(D), log2_ceil_py(S * D)
    dense = {"org": 32, "int": 32, "q16": 16, "q8": 8, "q4": 4}
    if codec in dense:
        return dense[codec] * S * D
    width = 16 if codec.endswith("16") else 32
    if direction == "emb":
        return nnz * width + (heads + tails) * q2 + q0 + q1
    if codec.startswith("svfl"):
        return nnz * width + q0 + q1
    keep = min(k, S * D)
    return keep * q2 + keep * width + q0 + q1


# ------------------------------------------------------------------ parameters and optimisers

def xavier(n_in: int, n_out: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """M4: Xavier-uniform weight, bias 1; the same seed before every layer (as the reference)."""
    a = math.sqrt(6.0 / (n_in + n_out))
    return np.random.default_rng(seed).uniform(-a, a, size=(n_in, n_out)), np.ones(n_out)


class Flat:
    """Ordered named arrays <-> one vector."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.names = list(arrays)
        self.shapes = [arrays[n].shape for n in self.names]
        self.sizes = [int(np.prod(s)) for s in self.shapes]

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def pack(self, arrays: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.asarray(arrays[n], dtype=float).ravel() for n in self.names])

    def unpack(self, vec: np.ndarray) -> dict[str, np.ndarray]:
        out, o = {}, 0
        for n, shp, sz in zip(self.names, self.shapes, self.sizes):
            out[n] = vec[o:o + sz].reshape(shp)
            o += sz
        return out


@dataclass
class Optimiser:
    """Adam (default), SGD or RMSprop with torch's default constants."""
    kind: str = "adam"
    lr: float = 1e-3
    state: dict = field(default_factory=dict)
    # fixed values: torch defaults
    betas: tuple = (0.9, 0.999)
    eps: float = 1e-8
    alpha: float = 0.99

    def step(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.kind == "sgd":
            return theta - self.lr * g
        if self.kind == "rmsprop":
            v = self.alpha * self.state.get("v", np.zeros_like(g)) + (1 - self.alpha) * g * g
            self.state["v"] = v
            return theta - self.lr * g / (np.sqrt(v) + self.eps)
        t = self.state.get("t", 0) + 1
        m = self.betas[0] * self.state.get("m", np.zeros_like(g)) + (1 - self.betas[0]) * g
        v = self.betas[1] * self.state.get("v", np.zeros_like(g)) + (1 - self.betas[1]) * g * g
        self.state.update(t=t, m=m, v=v)
        mhat = m / (1 - self.betas[0] ** t)
        vhat = v / (1 - self.betas[1] ** t)
        return theta - self.lr * mhat / (np.sqrt(vhat) + self.eps)


# ------------------------------------------------------------------ the joint model in one batch

@dataclass
class JointConfig:
    in_sizes: list[int]
    dims: list[int]
    n_out: int = 1                  # 1 = binary (BCE with pos weight), >1 = classes (weighted CE)
    act: str = "relu"
    codec: str | None = "org"
    top_k: int = 1024
    lam: float = 0.0                # embedding penalty weight
    penalty_p: int = 1
    divisor: float = 3.0
    eps: float = 0.0                # embedding sparsity threshold
    grad_eps: float = 0.0           # gradient sparsity threshold
    pos_weight: float = 1.0
    class_weights: list[float] | None = None
    bias: bool = True
    fixed_parties: bool = False     # one-shot: inputs are already codes, no party layers
    axis: int = 1                   # run-length layout: 1 column-major, 0 row-major

    @property
    def n_parties(self) -> int:
        return len(self.in_sizes)


def joint_params(cfg: JointConfig, seed: int = 0) -> dict[str, np.ndarray]:
    P = {}
    if not cfg.fixed_parties:
        for p, (n, d) in enumerate(zip(cfg.in_sizes, cfg.dims)):
            P[f"party{p}.W"], P[f"party{p}.b"] = xavier(n, d, seed)
    total = sum(cfg.dims)
    P["hidden.W"], P["hidden.b"] = xavier(total, total // 2, seed)
    P["out.W"], P["out.b"] = xavier(total // 2, cfg.n_out, seed)
    return P


def stat_names(cfg: JointConfig) -> list[str]:
    names = ["loss", "penalty", "norm_sum", "rows", "batches", "embed_zero", "grad_zero"]
    for p in range(cfg.n_parties):
        names += [f"send_bytes_{p}", f"receive_bytes_{p}"]
    return names


def _x(pdf: pd.DataFrame | pa.Table, col: str, width: int) -> np.ndarray:
    """A column of arrays as a matrix; an Arrow column's values already lie end to end."""
    if len(pdf) == 0:
        return np.zeros((0, width))
    if isinstance(pdf, pa.Table):
        if pdf[col].null_count:
            raise ValueError(f"null array in {col}")
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in pdf[col].chunks])
        return values.astype(float).reshape(len(pdf), width)
    return np.stack([np.asarray(v, dtype=float) for v in pdf[col].to_numpy()]).reshape(len(pdf), width)


def joint_forward(pdf: pd.DataFrame, P: dict, cfg: JointConfig):
    X, pre, E, Ed = [], [], [], []
    for p in range(cfg.n_parties):
        width = cfg.in_sizes[p] if not cfg.fixed_parties else cfg.dims[p]
        x = np.nan_to_num(_x(pdf, f"x{p}", width))
        X.append(x)
        if cfg.fixed_parties:
            pr, e = x, x
        else:
            pr = x @ P[f"party{p}.W"] + (P[f"party{p}.b"] if cfg.bias else 0.0)
            e = act_np(cfg.act, pr)
        pre.append(pr)
        E.append(e)
        Ed.append(encode_decode_emb(e, cfg.codec))
    ecat = np.concatenate(Ed, axis=1)
    zh = ecat @ P["hidden.W"] + P["hidden.b"]
    h = np.maximum(zh, 0.0)
    z = h @ P["out.W"] + P["out.b"]
    return X, pre, E, ecat, zh, h, z


def row_losses(z: np.ndarray, pdf: pd.DataFrame, cfg: JointConfig):
    """Per-row weight and loss such that the batch loss is ``sum(w*l)/sum(w)`` (M7 / M8)."""
    if cfg.n_out == 1:
        y = pdf["y"].to_numpy().astype(float)
        zz = z[:, 0]
        l = cfg.pos_weight * y * _softplus(-zz) + (1 - y) * _softplus(zz)
        return np.ones_like(l), l
    c = pdf["cls"].to_numpy().astype(int)
    m = z.max(axis=1, keepdims=True)
    lse = (m + np.log(np.exp(z - m).sum(axis=1, keepdims=True)))[:, 0]
    w = np.asarray(cfg.class_weights, dtype=float)[c]
    return w, lse - z[np.arange(len(c)), c]


def joint_batch(pdf: pd.DataFrame, P: dict, cfg: JointConfig, flat: Flat) -> np.ndarray:
    """Gradient of the batch-mean loss (+ penalty) and the batch's statistics, as one vector."""
    S = len(pdf)
    X, pre, E, ecat, zh, h, z = joint_forward(pdf, P, cfg)
    w, l = row_losses(z, pdf, cfg)
    loss = float((w * l).sum() / w.sum())
    if cfg.n_out == 1:
        y = pdf["y"].to_numpy().astype(float)
        zz = z[:, 0]
        dz = ((-cfg.pos_weight * y * _sigmoid(-zz) + (1 - y) * _sigmoid(zz)) / S)[:, None]
    else:
        c = pdf["cls"].to_numpy().astype(int)
        sm = np.exp(z - z.max(axis=1, keepdims=True))
        sm /= sm.sum(axis=1, keepdims=True)
        sm[np.arange(S), c] -= 1.0
        dz = sm * (w / w.sum())[:, None]
    G = {n: np.zeros(s) for n, s in zip(flat.names, flat.shapes)}
    G["out.W"] = h.T @ dz
    G["out.b"] = dz.sum(axis=0)
    dh = (dz @ P["out.W"].T) * (zh > 0)
    G["hidden.W"] = ecat.T @ dh
    G["hidden.b"] = dh.sum(axis=0)
    de = dh @ P["hidden.W"].T
    penalty = 0.0
    stats = dict(loss=loss, rows=S, batches=1)
    off = 0
    grad_zero = 0
    norm_sum = 0.0
    for p, d in enumerate(cfg.dims):
        e = E[p]
        ed = ecat[:, off:off + d]          # the embedding as the server decoded it
        ge = de[:, off:off + d]
        off += d
        if cfg.lam and cfg.penalty_p:
            # the penalty is taken on the decoded embedding, so its gradient travels back too
            scale = cfg.lam / cfg.divisor / S
            if cfg.penalty_p == 1:
                norm = float(np.abs(ed).sum(axis=1).mean())
                ge = ge + scale * np.sign(ed)
            else:
                nrm = np.sqrt((ed * ed).sum(axis=1, keepdims=True))
                norm = float(nrm.mean())
                ge = ge + scale * np.where(nrm > 0, ed / np.where(nrm > 0, nrm, 1.0), 0.0)
            norm_sum += norm
            penalty += cfg.lam / cfg.divisor * norm
        gd = encode_decode_grad(ge, e, cfg.codec, cfg.top_k)
        grad_zero += int((np.abs(gd) <= cfg.grad_eps).sum())
        if not cfg.fixed_parties:
            dpre = gd * act_grad_np(cfg.act, pre[p], e)
            G[f"party{p}.W"] = X[p].T @ dpre
            G[f"party{p}.b"] = dpre.sum(axis=0)
        codec_name = cfg.codec or "org"
        if cfg.fixed_parties:
            # one-shot codes were sent once before training; nothing travels per epoch
            stats[f"send_bytes_{p}"] = stats[f"receive_bytes_{p}"] = 0
        else:
            nnz, hh, tt = run_stats(e, cfg.axis)
            stats[f"send_bytes_{p}"] = math.ceil(
                message_bits_np(codec_name, "emb", S, d, nnz, hh, tt, cfg.top_k) / 8)
            stats[f"receive_bytes_{p}"] = math.ceil(
                message_bits_np(codec_name, "grad", S, d, nnz, hh, tt, cfg.top_k) / 8)
    stats["penalty"] = penalty
    stats["norm_sum"] = norm_sum
    stats["embed_zero"] = int(sum((np.abs(e) <= cfg.eps).sum() for e in E))
    stats["grad_zero"] = grad_zero
    return np.concatenate([flat.pack(G), np.array([stats[n] for n in stat_names(cfg)], dtype=float)])


def joint_scores(pdf: pd.DataFrame, P: dict, cfg: JointConfig) -> pd.DataFrame:
    """Per row: score (binary: sigmoid; classes: argmax) and its share of the batch-mean loss."""
    _, _, E, _, _, _, z = joint_forward(pdf, P, cfg)
    w, l = row_losses(z, pdf, cfg)
    share = w * l / w.sum() if len(pdf) else l
    if cfg.n_out == 1:
        score = _sigmoid(z[:, 0])
        truth = pdf["y"].to_numpy()
        pred = (score >= 0.5).astype(int)
    else:
        score = z.max(axis=1)
        truth = pdf["cls"].to_numpy()
        pred = z.argmax(axis=1)
    zero = sum((np.abs(e) <= cfg.eps).sum(axis=1) for e in E) if E else np.zeros(len(pdf))
    out = pd.DataFrame({"uid": pdf["uid"].to_numpy(), "batch_id": pdf["batch_id"].to_numpy(),
                        "truth": truth.astype(int), "score": score,
                        "pred": pred.astype(int), "loss_share": share, "embed_zero": zero.astype(int)})
    # the batch's embedding messages (sent, never answered), booked on its first row
    for p, e in enumerate(E):
        sent = np.zeros(len(pdf), dtype=np.int64)
        if len(pdf) and not cfg.fixed_parties:
            nnz, hh, tt = run_stats(e, cfg.axis)
            sent[0] = math.ceil(message_bits_np(cfg.codec or "org", "emb", len(pdf), e.shape[1], nnz, hh, tt,
                                                cfg.top_k) / 8)
        out[f"send_bytes_{p}"] = sent
    return out


# ------------------------------------------------------------------ Spark side

GRAD_SCHEMA = "k int, v double"


def prepare_batches(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partition rows on ``batch_id`` and sort them by it, once, and cache; every epoch's
    ``groupBy(batch_id)`` then plans no further shuffle and no sort."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "batch_id").sortWithinPartitions("batch_id").cache()


def batch_vector_frame(batched: DataFrame, fn) -> DataFrame:
    """``(k, v)``: sum over all batches of ``fn(batch's Arrow table) -> vector``.

    Hand in the columns that ``fn`` reads, with ``batch_id``.  One group per batch (bounded by the batch size); the per-batch vectors are
    model-sized, and their sum is a partial aggregation on ``k``.
    """

    def per_batch(rows: pa.Table) -> pa.Table:
        vec = fn(rows)
        return pa.table({"k": np.arange(len(vec), dtype=np.int32), "v": np.asarray(vec, dtype=float)})

    return (batched.groupBy("batch_id").applyInArrow(per_batch, GRAD_SCHEMA)
            .groupBy("k").agg(F.sum("v").alias("v")))


def batch_vectors(batched: DataFrame, fn, size: int) -> np.ndarray:
    """:func:`batch_vector_frame` brought to the driver as one model-sized vector."""
    rows = batch_vector_frame(batched, fn).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def joint_columns(cfg: JointConfig) -> list[str]:
    """The columns that the joint model reads from a batch."""
    return [f"x{p}" for p in range(cfg.n_parties)] + ["batch_id", "y" if cfg.n_out == 1 else "cls"]


def score_frame(batched: DataFrame, P: dict, cfg: JointConfig) -> DataFrame:
    cols = [*joint_columns(cfg), "uid"]
    schema = ("uid long, batch_id long, truth int, score double, pred int, loss_share double, embed_zero int, "
              + ", ".join(f"send_bytes_{p} long" for p in range(cfg.n_parties)))
    types = to_arrow_schema(StructType.fromDDL(schema))
    return batched.select(*cols).groupBy("batch_id").applyInArrow(
        lambda rows: pa.Table.from_pandas(joint_scores(rows, P, cfg), types, preserve_index=False), schema)


def evaluate_scores(scores: DataFrame, cfg: JointConfig) -> dict:
    """Score (AUC or macro-F1), loss (mean of batch means) and embedding sparsity of one split."""
    from partyframe.operators.evaluate import auc, macro_f1
    sends = [c for c in scores.columns if c.startswith("send_bytes_")]
    agg = scores.agg(F.sum("loss_share").alias("loss_sum"), F.count(F.lit(1)).alias("rows"),
                     F.sum("embed_zero").alias("zero"), F.countDistinct("batch_id").alias("nb"),
                     *[F.sum(c).alias(c) for c in sends]).first()
    n_batches = agg["nb"] or 1
    if cfg.n_out == 1:
        s = auc(scores, "score", "truth").first()["auc"]
    else:
        s = macro_f1(scores, "truth", "pred").first()["macro_f1"]
    rows = agg["rows"] or 0
    return dict(score=s, loss=(agg["loss_sum"] or 0.0) / max(1, n_batches),
                sparsity=(agg["zero"] or 0) / max(1, rows * sum(cfg.dims)), batches=n_batches,
                **{c: float(agg[c] or 0) for c in sends})


@dataclass
class FitResult:
    params: dict
    best_epoch: int
    metrics: list[tuple[str, int, float]]        # (tag, step, value)
    totals: dict


def fit_joint(tr: DataFrame, va: DataFrame, te: DataFrame | None, cfg: JointConfig, epochs: int = 5,
              lr: float = 1e-2, party_optimizer: str = "adam", seed: int = 0, patience: int | None = None,
              params: dict | None = None, step: str = "epoch", snapshot=None, on_epoch=None) -> FitResult:
    """Epochs of steps, validation after each, best snapshot (W7), optional
    early stop (W8), test scoring with the best snapshot.

    ``tr`` / ``va`` / ``te`` carry ``uid, x0.., y | cls, batch_id`` and should come from
    :func:`prepare_batches`.  ``step="epoch"`` (default) makes one update per epoch from the
    gradient of the epoch loss - one Spark job; ``step="batch"`` makes one update per batch in
    batch order, as the reference does - one Spark job per batch, meant for few batches.
    ``snapshot(params, epoch)`` is called whenever the validation score improves (S10);
    ``on_epoch(rows)`` receives each epoch's metric rows as soon as they exist (S8), e.g. to
    append them to a log that :mod:`partyframe.streaming.monitor` follows.
    """
    P = params or joint_params(cfg, seed)
    flat = Flat(P)
    names = stat_names(cfg)
    head_opt = Optimiser("adam", lr)
    party_opt = Optimiser(party_optimizer, lr)
    head_keys = [n for n in flat.names if not n.startswith("party")]
    party_keys = [n for n in flat.names if n.startswith("party")]
    metrics: list[tuple[str, int, float]] = []
    best, best_epoch, best_P, waiting = -1.0, -1, P, 0
    totals = {n: 0.0 for n in names if n.endswith(tuple(f"_{p}" for p in range(cfg.n_parties)))}
    batch_ids = None
    for epoch in range(epochs):
        t0 = time.time()

        def apply(P, g, scale):
            for keys, opt in ((head_keys, head_opt), (party_keys, party_opt)):
                if not keys:
                    continue
                theta = np.concatenate([P[k].ravel() for k in keys])
                grad = np.concatenate([g[k].ravel() for k in keys]) * scale
                new = opt.step(theta, grad)
                o = 0
                P = dict(P)
                for k in keys:
                    sz = P[k].size
                    P[k] = new[o:o + sz].reshape(P[k].shape)
                    o += sz
            return P

        if step == "batch":
            if batch_ids is None:
                # batch ids are dense (0 .. n-1, from the dense index): one number is enough
                batch_ids = range(int(tr.agg(F.max("batch_id")).first()[0]) + 1)
            st = dict.fromkeys(names, 0.0)
            for b in batch_ids:
                vec = batch_vectors(tr.filter(F.col("batch_id") == b).select(*joint_columns(cfg)),
                                    lambda pdf, P=P: joint_batch(pdf, P, cfg, flat), flat.size + len(names))
                P = apply(P, flat.unpack(vec[:flat.size]), 1.0)
                for n, v in zip(names, vec[flat.size:]):
                    st[n] += v
            nb = max(1.0, st["batches"])
        else:
            vec = batch_vectors(tr.select(*joint_columns(cfg)), lambda pdf, P=P: joint_batch(pdf, P, cfg, flat), flat.size + len(names))
            st = dict(zip(names, vec[flat.size:]))
            nb = max(1.0, st["batches"])
            # step on the epoch loss = mean of batch-mean losses
            P = apply(P, flat.unpack(vec[:flat.size]), 1.0 / nb)
        ev = evaluate_scores(score_frame(va, P, cfg), cfg)
        tag = "auc" if cfg.n_out == 1 else "macrof1"
        metrics += [("tr/loss", epoch, st["loss"] / nb + st["penalty"] / nb),
                    ("va/loss", epoch, ev["loss"]), (f"va/{tag}", epoch, ev["score"] if ev["score"] is not None else float("nan")),
                    ("reg/tr_sparse_embed_loss_x_lambda", epoch, cfg.lam * st["norm_sum"] / nb),
                    ("reg/tr_embed_sparsity", epoch, st["embed_zero"] / max(1.0, st["rows"] * sum(cfg.dims))),
                    ("reg/tr_grad_sparsity", epoch, st["grad_zero"] / max(1.0, st["rows"] * sum(cfg.dims))),
                    ("reg/va_embed_sparsity", epoch, ev["sparsity"])]
        # validation embeddings are sent every epoch too (never answered)
        for p in range(cfg.n_parties):
            st[f"send_bytes_{p}"] += ev.get(f"send_bytes_{p}", 0.0)
        send = sum(st[f"send_bytes_{p}"] for p in range(cfg.n_parties))
        recv = sum(st[f"receive_bytes_{p}"] for p in range(cfg.n_parties))
        messages = 0.0 if cfg.fixed_parties else float((2 * nb + ev["batches"]) * cfg.n_parties)
        metrics += [("stat_size/epoch_size_all", epoch, float(send + recv)),
                    ("stat_count/epoch_count_all", epoch, messages),
                    ("time/epoch_seconds", epoch, time.time() - t0)]
        for k in totals:
            totals[k] += st[k]
        if on_epoch is not None:
            on_epoch([m for m in metrics if m[1] == epoch])
        score = ev["score"] if ev["score"] is not None else -1.0
        if score > best:
            best, best_epoch, best_P, waiting = score, epoch, P, 0
            if snapshot is not None:
                snapshot(P, epoch)
        else:
            waiting += 1
            if patience is not None and waiting > patience:
                break
    if te is not None:
        ev = evaluate_scores(score_frame(te, best_P, cfg), cfg)
        metrics += [("te/score", best_epoch, ev["score"] if ev["score"] is not None else float("nan")),
                    ("te/embed_sparsity", best_epoch, ev["sparsity"])]
    return FitResult(best_P, best_epoch, metrics, totals)


# ------------------------------------------------------------------ autoencoder

def ae_params(in_size: int, dim: int, seed: int = 0) -> dict[str, np.ndarray]:
    """in -> in//2 -> dim -> in//2 -> in; ReLU after every layer but the last."""
    mid = max(1, in_size // 2)
    sizes = [(in_size, mid), (mid, dim), (dim, mid), (mid, in_size)]
    P = {}
    for i, (a, b) in enumerate(sizes):
        P[f"l{i}.W"], P[f"l{i}.b"] = xavier(a, b, seed)
    return P


def ae_forward(x: np.ndarray, P: dict):
    acts = [x]
    pres = []
    for i in range(4):
        z = acts[-1] @ P[f"l{i}.W"] + P[f"l{i}.b"]
        pres.append(z)
        acts.append(np.maximum(z, 0.0) if i < 3 else z)
    return pres, acts


def ae_batch(pdf: pd.DataFrame, P: dict, col: str, width: int, flat: Flat) -> np.ndarray:
    """Gradient of the batch MSE (mean over all cells) + (loss, rows, batches)."""
    x = np.nan_to_num(_x(pdf, col, width))
    pres, acts = ae_forward(x, P)
    diff = acts[-1] - x
    loss = float((diff ** 2).mean()) if diff.size else 0.0
    d = 2.0 * diff / max(1, diff.size)
    G = {}
    for i in reversed(range(4)):
        if i < 3:
            d = d * (pres[i] > 0)
        G[f"l{i}.W"] = acts[i].T @ d
        G[f"l{i}.b"] = d.sum(axis=0)
        d = d @ P[f"l{i}.W"].T
    return np.concatenate([flat.pack(G), [loss, len(pdf), 1.0]])


def fit_autoencoder(tr: DataFrame, va: DataFrame, col: str, width: int, dim: int, epochs: int = 5,
                    lr: float = 1e-2, patience: int = 2, seed: int = 0) -> tuple[dict, list]:
    """Full-pass Adam steps on the MSE, smallest validation loss kept, early stop always on."""
    P = ae_params(width, dim, seed)
    flat = Flat(P)
    opt = Optimiser("adam", lr)
    best, best_P, waiting, hist = float("inf"), P, 0, []
    tr, va = tr.select("batch_id", col), va.select("batch_id", col)
    for epoch in range(epochs):
        vec = batch_vectors(tr, lambda pdf, P=P: ae_batch(pdf, P, col, width, flat), flat.size + 3)
        nb = max(1.0, vec[-1])
        P = flat.unpack(opt.step(flat.pack(P), vec[:flat.size] / nb))
        vv = batch_vectors(va, lambda pdf, P=P: ae_batch(pdf, P, col, width, flat), flat.size + 3)
        va_loss = vv[-3] / max(1.0, vv[-1])
        hist.append((epoch, vec[-3] / nb, va_loss))
        if va_loss < best:
            best, best_P, waiting = va_loss, P, 0
        else:
            waiting += 1
            if waiting > patience:
                break
    return best_P, hist


def ae_codes(df: DataFrame, P: dict, col: str, width: int, out: str) -> DataFrame:
    """Encoder output (after its ReLU) as ``out ARRAY<DOUBLE>``, a per-partition numpy pass."""
    fields = [f for f in df.schema.fields if f.name != col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<double>"

    def run(it):
        for pdf in it:
            x = np.nan_to_num(_x(pdf, col, width))
            _, acts = ae_forward(x, P)
            res = pdf.drop(columns=[col])
            res[out] = list(acts[2])
            yield res

    return df.mapInPandas(run, schema)


def run_record(spark, run_id: str, cfg: JointConfig, res: FitResult, **config) -> DataFrame:
    """One run-log row - configuration, bytes per party and direction, total, test score,
    test embedding sparsity, training seconds - ready for ``io.append_run_log``.

    Parameters that do not apply stay null (the reference writes -1).
    """
    last = {t: v for t, _, v in res.metrics}
    row = dict(run_id=run_id, reduction=cfg.codec or "none", client_activation=cfg.act,
               interface_dims=",".join(str(d) for d in cfg.dims), out_size=cfg.n_out,
               sparse_embed_lambda=float(cfg.lam) if cfg.lam else None,
               sparse_embed_epsilon=float(cfg.eps), sparse_grad_epsilon=float(cfg.grad_eps),
               top_k=int(cfg.top_k) if (cfg.codec or "").startswith("topk") else None,
               norm=int(cfg.penalty_p) if cfg.lam else None, run_axis=int(cfg.axis),
               best_epoch=int(res.best_epoch))
    row.update(config)
    for d in ("send", "receive"):
        for p in range(cfg.n_parties):
            row[f"total_size_{d}_{p}"] = int(res.totals.get(f"{d}_bytes_{p}", 0))
    row["total_size_all"] = sum(row[f"total_size_{d}_{p}"] for d in ("send", "receive")
                                for p in range(cfg.n_parties))
    row["te_score"] = last.get("te/score")
    row["te_embed_sparsity"] = last.get("te/embed_sparsity")
    row["time"] = float(sum(v for t, _, v in res.metrics if t == "time/epoch_seconds"))
    nullable_longs = {"top_k", "norm"}

    def spark_type(k, v):
        if isinstance(v, str):
            return "string"
        if (isinstance(v, int) and not isinstance(v, bool)) or (v is None and k in nullable_longs):
            return "bigint"
        return "double"
    schema = ", ".join(f"`{k}` {spark_type(k, v)}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)
