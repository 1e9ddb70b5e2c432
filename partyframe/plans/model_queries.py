"""Scoring, loss, penalty and gradient queries over the star schema."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from partyframe.functions.numeric import round6, round_to
from partyframe.operators import align, model
from partyframe.operators.index import shuffled_batches
from partyframe.plans.registry import register
from partyframe.plans.star import SQL_STAR, WIDTHS, aligned, build_star

# fixed values: test-query parameters
DIM = 4            # embedding width per party
BATCH = 1024
SEED = 0
LAMBDA = 0.1
N_CLASSES = 3
ACTS = ("relu", "leaky_relu", "elu", "selu", "mish", "identity")


def params_binary():
    return model.rule_params(list(WIDTHS), DIM, 1)


def params_class():
    return model.rule_params(list(WIDTHS), DIM, N_CLASSES)


def scored(spark, sf_dir, params, act="relu", batches=False, keep_pre=False, star=None, labels=None):
    star = star or build_star(spark, sf_dir)
    if batches:
        labels = shuffled_batches(star.labels if labels is None else labels, "uid", BATCH, seed=SEED)
    al = aligned(star, labels)
    return model.head(model.embed(al, params, list(WIDTHS), act, keep_pre=keep_pre), params)


def fit_pos_weight(spark, sf_dir, star=None) -> float:
    return align.pos_weight((star or build_star(spark, sf_dir)).labels).first()["pos_weight"]


def fit_class_weights(spark, sf_dir, star=None) -> list[float | None]:
    return align.class_weight_list((star or build_star(spark, sf_dir)).labels, N_CLASSES, "cls")


# ------------------------------------------------------------------ SQL twins

def _lit_list(v) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]::DOUBLE[]"


def sql_linear(x: str, W: np.ndarray, b: np.ndarray | None) -> str:
    terms = []
    for d in range(W.shape[1]):
        t = f"list_dot_product({x}, {_lit_list(W[:, d])})"
        if b is not None:
            t += f" + {float(b[d])!r}"
        terms.append(t)
    return "[" + ", ".join(terms) + "]"


def sql_act(name: str, v: str) -> str:
    sp = f"(greatest({v}, 0) + ln(1 + exp(-abs({v}))))"
    return {
        "relu": f"greatest({v}, 0.0)",
        "leaky_relu": f"(CASE WHEN {v} >= 0 THEN {v} ELSE {v} * 0.01 END)",
        "elu": f"(CASE WHEN {v} > 0 THEN {v} ELSE exp({v}) - 1 END)",
        "selu": f"(1.0507009873554805 * CASE WHEN {v} > 0 THEN {v} ELSE 1.6732632423543772 * (exp({v}) - 1) END)",
        "mish": f"({v} * tanh({sp}))",
    }.get(name, v)


def sql_scored(params, act="relu", batches=False, batch_sql: str | None = None) -> str:
    """CTEs ending in ``sc``: al + (batch) + pre0.., e0.., zh, h, z.

    ``batch_sql`` gives other CTEs ending in ``bt`` (al with r, S and batch_id)."""
    pre = ", ".join(f"{sql_linear(f'x{p}', W, b)} AS pre{p}" for p, (W, b) in enumerate(params.party))
    emb = ", ".join(f"list_transform(pre{p}, lambda v: {sql_act(act, 'v')}) AS e{p}" for p in range(len(WIDTHS)))
    W1, b1 = params.hidden
    W2, b2 = params.out
    src = "al"
    bt = ""
    if batches:
        bt = f""",
bt0 AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || uid::VARCHAR), uid) - 1 AS r, count(*) OVER () AS n FROM al),
bt AS (SELECT *, r // {BATCH} AS batch_id, least({BATCH}, n - (r // {BATCH}) * {BATCH}) AS S FROM bt0)"""
        src = "bt"
    if batch_sql:
        bt, src = f",\n{batch_sql}", "bt"
    ecat = " || ".join(f"e{p}" for p in range(len(WIDTHS)))
    return f"""{SQL_STAR}{bt},
pr AS (SELECT *, {pre} FROM {src}),
em AS (SELECT *, {emb} FROM pr),
hz AS (SELECT *, {sql_linear(ecat, W1, b1)} AS zh FROM em),
hh AS (SELECT *, list_transform(zh, lambda v: greatest(v, 0.0)) AS h FROM hz),
sc AS (SELECT *, {sql_linear('h', W2, b2)} AS z FROM hh)"""


SQL_POS_WEIGHT = "pw AS (SELECT (count(*) - sum(y)) / sum(y) AS pw FROM lab)"
SQL_CLASS_WEIGHT = "cw AS (SELECT cls, (SELECT count(*) FROM lab) / count(*) AS w FROM lab GROUP BY cls)"


# ------------------------------------------------------------------ scoring (M1-M3, M5, M6)

@register("embed_relu", f"""
WITH {sql_scored(params_binary())}
SELECT uid, p::INTEGER AS party, (unnest(range(0, {DIM})))::INTEGER AS d,
       round(unnest(CASE p WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END), 6) AS v
FROM sc, range(0, 3) t(p)
""")
def embed_relu(spark, sf_dir):
    """M1 / M2: every party's ReLU embedding (uid, party, d, v)."""
    sc = scored(spark, sf_dir, params_binary())
    parts = F.array(*[F.struct(F.lit(p).alias("party"), F.col(f"e{p}").alias("e")) for p in range(3)])
    x = sc.select("uid", F.explode(parts).alias("pe"))
    return x.select("uid", "pe.party", F.posexplode("pe.e").alias("d", "v")).select(
        "uid", F.col("party").cast("int"), F.col("d").cast("int"), round6("v").alias("v"))


def _acts_sql():
    parts = []
    for a in ACTS:
        parts.append(f"SELECT uid, '{a}' AS act, round(list_sum(list_transform(pre0, lambda v: {sql_act(a, 'v')})), 6) AS s FROM sc")
    return f"WITH {sql_scored(params_binary())}\n" + "\nUNION ALL\n".join(parts)


@register("embed_activations", _acts_sql())
def embed_activations(spark, sf_dir):
    """M2: party 0's pre-activation through every activation (sum per row)."""
    params = params_binary()
    sc = scored(spark, sf_dir, params, keep_pre=True)
    rows = []
    for a in ACTS:
        acc = None
        for c in model.items("pre0", DIM):
            t = model.activation(a, c) if a != "identity" else c
            acc = t if acc is None else acc + t
        rows.append(F.struct(F.lit(a).alias("act"), round6(acc).alias("s")))
    return sc.select("uid", F.explode(F.array(*rows)).alias("r")).select("uid", "r.act", "r.s")


@register("head_score", f"""
WITH {sql_scored(params_binary())}
SELECT uid, round(z[1], 6) AS z FROM sc
""")
def head_score(spark, sf_dir):
    """M3: server head output (binary) per row."""
    return scored(spark, sf_dir, params_binary()).select("uid", round6(F.col("z")[0]).alias("z"))


@register("predict_binary", f"""
WITH {sql_scored(params_binary())}
SELECT uid, y, round(1 / (1 + exp(-z[1])), 6) AS p FROM sc
""")
def predict_binary(spark, sf_dir):
    """M5: sigmoid of the head output."""
    sc = scored(spark, sf_dir, params_binary())
    return sc.select("uid", "y", round6(model.predict_binary(F.col("z")[0])).alias("p"))


@register("predict_class", f"""
WITH {sql_scored(params_class())}
SELECT uid, cls, (list_position(z, list_max(z)) - 1)::INTEGER AS pred FROM sc
""")
def predict_class(spark, sf_dir):
    """M6: argmax of the 3-class head (ties: lowest class)."""
    sc = scored(spark, sf_dir, params_class())
    return sc.select("uid", "cls", model.predict_class("z").alias("pred"))


# ------------------------------------------------------------------ losses

SQL_BCE = "(pw * y * (greatest(-z[1], 0) + ln(1 + exp(-abs(z[1])))) + (1 - y) * (greatest(z[1], 0) + ln(1 + exp(-abs(z[1])))))"


@register("loss_binary", f"""
WITH {sql_scored(params_binary(), batches=True)}, {SQL_POS_WEIGHT}
SELECT batch_id::BIGINT AS batch_id, round(avg({SQL_BCE}), 6) AS loss FROM sc, pw GROUP BY batch_id
""")
def loss_binary(spark, sf_dir):
    """M7: positive-weighted BCE, mean over the rows of each batch."""
    star = build_star(spark, sf_dir)
    pw = fit_pos_weight(spark, sf_dir, star)
    sc = scored(spark, sf_dir, params_binary(), batches=True, star=star)
    return sc.groupBy("batch_id").agg(round6(F.avg(model.bce_row(F.col("z")[0], F.col("y"), pw))).alias("loss"))


SQL_LSE = "(list_max(z) + ln(list_sum(list_transform(z, lambda t: exp(t - list_max(z))))))"


@register("loss_class", f"""
WITH {sql_scored(params_class(), batches=True)}, {SQL_CLASS_WEIGHT}
SELECT batch_id::BIGINT AS batch_id, round(sum(w * ({SQL_LSE} - z[cls + 1])) / sum(w), 6) AS loss
FROM sc JOIN cw USING (cls) GROUP BY batch_id
""")
def loss_class(spark, sf_dir):
    """M8: class-weighted cross entropy; divisor = sum of the batch's weights."""
    star = build_star(spark, sf_dir)
    cw = fit_class_weights(spark, sf_dir, star)
    sc = scored(spark, sf_dir, params_class(), batches=True, star=star)
    w = model.class_weight_of(F.col("cls"), cw)
    nll = model.nll_row("z", N_CLASSES, F.col("cls"))
    return sc.groupBy("batch_id").agg(round6(F.sum(w * nll) / F.sum(w)).alias("loss"))


def _penalty_sql(p: int) -> str:
    norms = []
    for q in range(3):
        if p == 1:
            norms.append(f"list_sum(list_transform(e{q}, lambda v: abs(v)))")
        else:
            norms.append(f"sqrt(list_sum(list_transform(e{q}, lambda v: v * v)))")
    return f"""
WITH {sql_scored(params_binary(), batches=True)}
SELECT batch_id::BIGINT AS batch_id, round({LAMBDA} / 3.0 * ({" + ".join(f"avg({n})" for n in norms)}), 6) AS penalty
FROM sc GROUP BY batch_id
"""


def _penalty(spark, sf_dir, p):
    sc = scored(spark, sf_dir, params_binary(), batches=True)
    return sc.groupBy("batch_id").agg(round6(F.avg(model.penalty_rows([DIM] * 3, p, LAMBDA))).alias("penalty"))


@register("penalty_l1", _penalty_sql(1))
def penalty_l1(spark, sf_dir):
    """M9: lambda/3 * sum over parties of the batch mean of row L1 norms."""
    return _penalty(spark, sf_dir, 1)


@register("penalty_l2", _penalty_sql(2))
def penalty_l2(spark, sf_dir):
    """M9 with the L2 norm."""
    return _penalty(spark, sf_dir, 2)


@register("epoch_loss", f"""
WITH {sql_scored(params_binary(), batches=True)}, {SQL_POS_WEIGHT},
bl AS (SELECT batch_id, avg({SQL_BCE}) AS loss,
              {LAMBDA} / 3.0 * ({" + ".join(f"avg(list_sum(list_transform(e{q}, lambda v: abs(v))))" for q in range(3))}) AS pen
       FROM sc, pw GROUP BY batch_id)
SELECT count(*)::BIGINT AS batches, round(avg(loss), 6) AS loss, round(avg(loss + pen), 6) AS loss_with_penalty FROM bl
""")
def epoch_loss(spark, sf_dir):
    """Unweighted mean of batch means (a short last batch counts fully); train loss adds the penalty."""
    star = build_star(spark, sf_dir)
    pw = fit_pos_weight(spark, sf_dir, star)
    sc = scored(spark, sf_dir, params_binary(), batches=True, star=star)
    bl = sc.groupBy("batch_id").agg(
        F.avg(model.bce_row(F.col("z")[0], F.col("y"), pw)).alias("loss"),
        F.avg(model.penalty_rows([DIM] * 3, 1, LAMBDA)).alias("pen"))
    return bl.agg(F.count(F.lit(1)).alias("batches"), round6(F.avg("loss")).alias("loss"),
                  round6(F.avg(F.col("loss") + F.col("pen"))).alias("loss_with_penalty"))


# ------------------------------------------------------------------ gradients

def _grad_frame(spark, sf_dir):
    params = params_binary()
    star = build_star(spark, sf_dir)
    pw = fit_pos_weight(spark, sf_dir, star)
    sc = scored(spark, sf_dir, params, batches=True, keep_pre=True, star=star)
    g = model.grad_z_binary(sc, pw)
    return model.grad_embeddings(g, params, penalty_p=1, lam=LAMBDA), params


def _sql_grad_rows(params) -> str:
    W1, _ = params.hidden
    W2, _ = params.out
    n_h = W2.shape[0]
    dz = ("((-pw * y / (1 + exp(z[1])) + (1 - y) / (1 + exp(-z[1]))) / S)")
    dh = "[" + ", ".join(f"CASE WHEN zh[{k + 1}] > 0 THEN dz * {float(W2[k, 0])!r} ELSE 0.0 END" for k in range(n_h)) + "]"
    ge = []
    off = 0
    for p in range(3):
        block = W1[off:off + DIM, :]
        terms = [f"list_dot_product(dh, {_lit_list(block[m, :])}) + {LAMBDA} / 3.0 / S * sign(e{p}[{m + 1}])"
                 for m in range(DIM)]
        ge.append(f"[{', '.join(terms)}] AS ge{p}")
        off += DIM
    return f"""{sql_scored(params, batches=True)}, {SQL_POS_WEIGHT},
g1 AS (SELECT sc.*, {dz} AS dz FROM sc, pw),
g2 AS (SELECT *, {dh} AS dh FROM g1),
gr AS (SELECT *, {", ".join(ge)} FROM g2)"""


@register("embed_gradient", f"""
WITH {_sql_grad_rows(params_binary())}
SELECT uid, (unnest(range(0, {3 * DIM})))::INTEGER AS m, unnest(list_transform(ge0 || ge1 || ge2, lambda v: CASE WHEN round(v, 9) = 0 THEN 0.0 ELSE round(v, 9) END)) AS g FROM gr
""")
def embed_gradient(spark, sf_dir):
    """Gradient of (batch-mean BCE + L1 penalty) w.r.t. every party embedding, per row."""
    g, _ = _grad_frame(spark, sf_dir)
    return g.select("uid", F.posexplode(F.concat("ge0", "ge1", "ge2")).alias("m", "g")).select(
        "uid", F.col("m").cast("int").alias("m"), round_to("g", 9).alias("g"))


def _weight_grad_sql() -> str:
    params = params_binary()
    n_h = params.out[0].shape[0]
    parts = [
        f"SELECT 'out.W' AS layer, k::INTEGER AS r, 0 AS c, round(sum(dz * h[k + 1]), 9) + 0.0 AS grad FROM gr, range(0, {n_h}) t(k) GROUP BY k",
        "SELECT 'out.b', 0, 0, round(sum(dz), 9) FROM gr",
        f"SELECT 'hidden.W', m::INTEGER, k::INTEGER, round(sum(dh[k + 1] * (e0 || e1 || e2)[m + 1]), 9) FROM gr, range(0, {3 * DIM}) t(m), range(0, {n_h}) u(k) GROUP BY m, k",
        f"SELECT 'hidden.b', k::INTEGER, 0, round(sum(dh[k + 1]), 9) FROM gr, range(0, {n_h}) t(k) GROUP BY k",
    ]
    for p in range(3):
        dpre = f"(ge{p}[m + 1] * (pre{p}[m + 1] > 0)::DOUBLE)"
        parts.append(f"SELECT 'party{p}.W', j::INTEGER, m::INTEGER, round(sum(x{p}[j + 1] * {dpre}), 9) "
                     f"FROM gr, range(0, {WIDTHS[p]}) t(j), range(0, {DIM}) u(m) GROUP BY j, m")
        parts.append(f"SELECT 'party{p}.b', m::INTEGER, 0, round(sum({dpre}), 9) FROM gr, range(0, {DIM}) u(m) GROUP BY m")
    return f"WITH {_sql_grad_rows(params)}\n" + "\nUNION ALL\n".join(parts)


@register("weight_gradient", _weight_grad_sql())
def weight_gradient(spark, sf_dir):
    """Gradient of every parameter summed over one epoch of batch-mean losses (+ L1 penalty).

    Outer products per row, summed as vectors in the JVM; a model-sized names table (broadcast) labels them.
    """
    g, params = _grad_frame(spark, sf_dir)
    sums = model.weight_gradients(g, params)
    names, k = [], 0
    for layer, arr in params.flat():
        for layer_, r, c, _ in _cells(layer, arr):
            names.append((k, layer_, r, c))
            k += 1
    labels = spark.createDataFrame(names, "k int, layer string, r int, c int")
    return sums.join(F.broadcast(labels), "k").select("layer", "r", "c", round_to("v", 9).alias("grad"))


def _cells(name, arr):
    if arr.ndim == 2:
        return [(name, r, c, True) for r in range(arr.shape[0]) for c in range(arr.shape[1])]
    return [(name, r, 0, False) for r in range(arr.shape[0])]
