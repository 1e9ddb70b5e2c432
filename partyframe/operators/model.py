"""Party embeddings, server head, losses, penalty and closed-form gradients.

Model parameters are tiny (hundreds of numbers) and live on the driver as
numpy arrays; a weight matrix enters the plan as one array literal.  A
linear layer is one expression over it (:func:`linear`), so the plan and the
generated code have the same size for 3 inputs and for 500.  Stored snapshots
enter as rows instead and meet the data in a join (:func:`score_snapshots`).
Fits run per batch in :mod:`partyframe.operators.fit`.

Shapes: party p: ``e_p = act(x_p W_p + b_p)`` (W_p: in_p x D);
head: ``h = relu(concat(e) W1 + b1)``, ``z = h W2 + b2`` (1 output for binary,
C for multi-class).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.functions.numeric import activation, activation_slope, sigmoid, softplus


# ------------------------------------------------------------------ parameters

def rule_weights(n_in: int, n_out: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Closed-form weights so SQL can repeat them: ``w[j][d] = ((7j + 13d + salt) % 11 - 5) / 10``."""
    W = np.array([[((7 * j + 13 * d + salt) % 11 - 5) / 10.0 for d in range(n_out)] for j in range(n_in)])
    b = np.array([((3 * d + salt) % 5 - 2) / 10.0 for d in range(n_out)])
    return W, b



@dataclass
class Params:
    party: list[tuple[np.ndarray, np.ndarray]]
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    bias: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def dims(self) -> list[int]:
        return [W.shape[1] for W, _ in self.party]

    def flat(self) -> list[tuple[str, np.ndarray]]:
        items = []
        for p, (W, b) in enumerate(self.party):
            items += [(f"party{p}.W", W), (f"party{p}.b", b)]
        items += [("hidden.W", self.hidden[0]), ("hidden.b", self.hidden[1]),
                  ("out.W", self.out[0]), ("out.b", self.out[1])]
        return items


def rule_params(in_sizes: list[int], dim: int, n_out: int = 1, salt: int = 0) -> Params:
    party = [rule_weights(n, dim, salt=salt + p) for p, n in enumerate(in_sizes)]
    total = dim * len(in_sizes)
    hidden = rule_weights(total, total // 2, salt=salt + len(in_sizes))
    out = rule_weights(total // 2, n_out, salt=salt + len(in_sizes) + 1 + (n_out > 1))
    return Params(party, hidden, out)



# ------------------------------------------------------------------ expressions

def items(col: str, n: int) -> list[Column]:
    return [F.col(col)[j] for j in range(n)]


def matrix_literal(rows: list, ddl: str) -> Column:
    """A nested literal from JSON text: one expression, which the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(rows)), ddl)


def linear(x: Column, W: np.ndarray, b: np.ndarray | None, act: str | None = None) -> Column:
    """``act(sum_j x[j] * W[j][d] (+ b[d]))`` for every output d, as an ``ARRAY<DOUBLE>`` (null where x is)."""
    bias = np.zeros(W.shape[1]) if b is None else b
    outputs = matrix_literal([{"w": [float(v) for v in W[:, d]], "b": float(bias[d])} for d in range(W.shape[1])],
                             "array<struct<w: array<double>, b: double>>")
    return linear_of(x, outputs, act)


def linear_of(x: Column, outputs: Column, act: str | None = None) -> Column:
    """:func:`linear` by the outputs' (weights ``w``, bias ``b``), a literal or a column of the row."""
    def one(v: Column, o: Column) -> Column:
        total = F.aggregate(F.zip_with(v, o["w"], lambda u, w: u.cast("double") * w), F.lit(0.0), lambda a, u: a + u)
        return activation(act, total + o["b"]) if act else total + o["b"]

    return bound(x, lambda v: F.transform(outputs, lambda o: one(v, o)))


def bound(x: Column, fn) -> Column:
    """``fn(x)`` with ``x`` computed once a row, however often ``fn`` reads it inside its lambdas.

    The optimizer puts a column's whole expression where the column is read once; inside a lambda that is once per
    element, so every layer over another would multiply the work of all layers below it.
    """
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def embed(df: DataFrame, params: Params, in_sizes: list[int], act: str = "relu",
          keep_pre: bool = False) -> DataFrame:
    """M1 / M2: ``e{p} = act(x{p} W_p + b_p)`` for every party (arrays ``e0 .. ek``)."""
    out = df
    for p, (W, b) in enumerate(params.party):
        if W.shape[0] != in_sizes[p]:
            raise ValueError(f"party {p}: {W.shape[0]} weights for {in_sizes[p]} inputs")
        pre = linear(F.col(f"x{p}"), W, b if params.bias else None)
        if keep_pre:
            out = out.withColumn(f"pre{p}", pre)
            pre = F.col(f"pre{p}")
        out = out.withColumn(f"e{p}", F.transform(pre, lambda v: activation(act, v)))
    return out


def head(df: DataFrame, params: Params, emb_cols: list[str] | None = None) -> DataFrame:
    """M3: ``zh = concat(e) W1 + b1``, ``h = relu(zh)``, ``z = h W2 + b2`` (arrays)."""
    cols = emb_cols or [f"e{p}" for p in range(len(params.dims))]
    W1, b1 = params.hidden
    W2, b2 = params.out
    out = df.withColumn("zh", linear(F.concat(*[F.col(c) for c in cols]), W1, b1))
    out = out.withColumn("h", F.transform("zh", lambda v: F.greatest(v, F.lit(0.0))))
    return out.withColumn("z", linear(F.col("h"), W2, b2))


def predict_binary(z: Column) -> Column:
    """M5."""
    return sigmoid(z)


def predict_class(z_col: str) -> Column:
    """M6: argmax, ties to the lowest class."""
    return (F.array_position(F.col(z_col), F.array_max(z_col)) - 1).cast("int")


# ------------------------------------------------------------------ snapshots as data

def snapshot_models(snapshots: DataFrame) -> DataFrame:
    """Stored snapshot rows (run_id, epoch, layer, r, row) as one model per row: (run_id, epoch, layers).

    ``layers`` maps a layer's name to its outputs as :func:`linear_of` takes them.  A group is the rows of
    one weight matrix.  Rows that a repeated write stored twice count once.
    """
    keys = ["run_id", "epoch"]
    rows = snapshots.groupBy(*keys, "layer", "r").agg(F.max("row").alias("row"))
    name, kind = F.regexp_extract("layer", r"^(.*)\.[Wb]$", 1), F.regexp_extract("layer", r"\.([Wb])$", 1)
    whole = rows.groupBy(*keys, name.alias("name")).agg(
        F.array_sort(F.collect_list(F.when(kind == "W", F.struct("r", "row")))).alias("W"),
        F.max(F.when(kind == "b", F.col("row"))).alias("b"))
    outputs = F.transform("b", lambda b, d: F.struct(F.transform(F.col("W.row"), lambda w: w[d]).alias("w"),
                                                     b.alias("b")))
    return whole.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("name", outputs.alias("outputs")))).alias("layers"))


def score_snapshots(rows: DataFrame, models: DataFrame, n_parties: int, act: str = "relu") -> DataFrame:
    """M1-M3 by stored weights: ``rows`` (run_id, x0 .. xk, ..) joined on ``run_id`` with their run's models.

    Each row comes once per model of its run, with the model's ``epoch`` and the arrays e0 .., zh, h, z.
    """
    out = rows.join(models, "run_id")
    for p in range(n_parties):
        out = out.withColumn(f"e{p}", linear_of(F.col(f"x{p}"), F.col("layers")[f"party{p}"], act))
    out = out.withColumn("zh", linear_of(F.concat(*[F.col(f"e{p}") for p in range(n_parties)]),
                                         F.col("layers")["hidden"]))
    out = out.withColumn("h", F.transform("zh", lambda v: F.greatest(v, F.lit(0.0))))
    return out.withColumn("z", linear_of(F.col("h"), F.col("layers")["out"])).drop("layers")


# ------------------------------------------------------------------ losses (M7-M9)

def bce_row(z: Column, y: Column, pos_weight) -> Column:
    """M7 per row: ``pw * y * softplus(-z) + (1 - y) * softplus(z)``."""
    y = y.cast("double")
    return F.lit(pos_weight) * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)


def logsumexp(zs: list[Column]) -> Column:
    m = F.greatest(*zs) if len(zs) > 1 else zs[0]
    s = None
    for z in zs:
        t = F.exp(z - m)
        s = t if s is None else s + t
    return m + F.log(s)


def nll_row(z_col: str, n_out: int, y: Column) -> Column:
    """M8 per row: ``logsumexp(z) - z[y]``."""
    zs = items(z_col, n_out)
    return logsumexp(zs) - F.col(z_col)[y]


def class_weight_of(y: Column, weights: list[float | None]) -> Column:
    """Weight of a class; null for a class that had no rows."""
    return F.array(*[F.lit(w).cast("double") for w in weights])[y]


def row_norm(col: str, n: int, p: int) -> Column:
    term = (lambda a, v: a + F.abs(v)) if p == 1 else (lambda a, v: a + v * v)
    total = F.aggregate(F.slice(col, 1, n), F.lit(0.0), term)
    return total if p == 1 else F.sqrt(total)


def penalty_rows(dims: list[int], p: int, lam: float, divisor: float = 3.0) -> Column:
    """M9 per row: ``lam / divisor * sum_p ||e_p||``; averaged per batch it is the reference's penalty."""
    acc = None
    for q, d in enumerate(dims):
        n = row_norm(f"e{q}", d, p)
        acc = n if acc is None else acc + n
    return F.lit(lam / divisor) * acc


# ------------------------------------------------------------------ gradients

def grad_z_binary(df: DataFrame, pos_weight: float, y: str = "y", batch_rows: str = "batch_rows") -> DataFrame:
    """dL/dz of the batch-mean weighted BCE: ``(-pw*y*sigmoid(-z) + (1-y)*sigmoid(z)) / S``."""
    z = F.col("z")[0]
    yy = F.col(y).cast("double")
    g = (-F.lit(pos_weight) * yy * sigmoid(-z) + (F.lit(1.0) - yy) * sigmoid(z)) / F.col(batch_rows)
    return df.withColumn("dz", F.array(g))



def grad_embeddings(df: DataFrame, params: Params, penalty_p: int = 0, lam: float = 0.0,
                    divisor: float = 3.0, batch_rows: str = "batch_rows") -> DataFrame:
    """``dh = (dz W2^T) * (zh > 0)``, ``de = dh W1^T`` split per party (``ge0 .. gek``),
    plus the penalty term (L1: ``sign(e)``, L2: ``e / ||e||``) times ``lam / divisor / S``."""
    W1, _ = params.hidden
    W2, _ = params.out
    through = linear(F.col("dz"), W2.T, None)
    out = df.withColumn("dh", F.zip_with(through, "zh", lambda g, z: F.when(z > 0, g).otherwise(F.lit(0.0))))
    offset = 0
    for p, d in enumerate(params.dims):
        ge = linear(F.col("dh"), W1[offset:offset + d, :].T, None)
        if lam and penalty_p:
            scale = F.lit(lam / divisor) / F.col(batch_rows)
            if penalty_p == 1:
                ge = F.zip_with(ge, f"e{p}", lambda g, e: g + scale * F.signum(e))
            else:
                norm = row_norm(f"e{p}", d, 2)
                ge = F.zip_with(ge, f"e{p}", lambda g, e: g + scale * F.when(norm > 0, e / norm).otherwise(F.lit(0.0)))
        out = out.withColumn(f"ge{p}", ge)
        offset += d
    return out


def outer(a: Column, b: Column) -> Column:
    """Cells of the outer product of two arrays, row by row."""
    return bound(b, lambda w: F.flatten(F.transform(a, lambda u: F.transform(w, lambda v: u.cast("double") * v))))


def weight_gradients(df: DataFrame, params: Params, act: str = "relu") -> DataFrame:
    """``(k, v)``, the gradient of parameter ``k`` (in the order of ``params.flat()``) summed over all rows.

    ``df`` comes from :func:`grad_embeddings` with ``x{p}`` and ``pre{p}`` kept.  A row gives the outer products
    of each layer's inputs and its outputs' gradients as one vector, and the vectors are summed in the
    JVM, once per task and then over tasks.  An empty table gives no rows.
    """
    cells = []
    for p in range(len(params.party)):
        slope = F.zip_with(f"ge{p}", f"pre{p}", lambda g, v: g * activation_slope(act, v))
        cells += [outer(F.col(f"x{p}"), slope), slope if params.bias else F.transform(slope, lambda g: g * 0.0)]
    ecat = F.concat(*[F.col(f"e{p}") for p in range(len(params.party))])
    cells += [outer(ecat, F.col("dh")), F.col("dh"), outer(F.col("h"), F.col("dz")), F.col("dz")]
    vectors = df.select(array_to_vector(F.concat(*cells)).alias("v"))
    total = vectors.groupBy(F.lit(0).alias("one")).agg(Summarizer.sum(F.col("v")).alias("v"))
    return total.select(F.posexplode(vector_to_array("v")).alias("k", "v"))
