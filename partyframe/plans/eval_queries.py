"""Evaluation and accounting queries.

Scores come from the star schema scored with the closed-form weights; epochs
come from ``events`` (run = event type, epoch = day since the first day,
score = mean value), so every query grows with its input tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyframe.functions.numeric import round6, round_to
from partyframe.operators import codec, evaluate, model
from partyframe.operators.index import assign_batches, md5_order_key, seeded_split
from partyframe.plans.inputs import sql_bytes, sql_ceil_log2
from partyframe.plans.model_queries import (BATCH, DIM, LAMBDA, SEED, SQL_BCE, SQL_POS_WEIGHT, fit_pos_weight,
                                            params_binary, params_class, scored, sql_scored)
from partyframe.plans.registry import register
from partyframe.plans.star import WIDTHS, aligned, build_star
from partyframe.sources.io import params_frame
from partyframe.sources.tables import read_table

# fixed values: test-query parameters
SPLIT_SEED = 7
PATIENCE = 2
PARTIES = (0, 1, 2)
GRID_K = 256
ONESHOT_CODECS = ("org", "q16", "q8", "q4")


# ------------------------------------------------------------------ shared frames

def scored_split(spark, sf_dir, params, cols=("uid", "y", "cls", "z")):
    """Scored star rows with their split, which is numbered on the labels alone."""
    star = build_star(spark, sf_dir)
    split = seeded_split(star.labels, "uid", (0.1, 0.1), ("tr", "va", "te"), seed=SPLIT_SEED)
    return scored(spark, sf_dir, params, star=star, labels=split).select(*cols, "split")


def _sql_split(src: str) -> str:
    """Twin of seeded_split(.., (0.1, 0.1), ('tr','va','te')) on the ``uid`` of ``src``."""
    return f"""
sp0 AS (SELECT uid, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || uid::VARCHAR), uid) - 1 AS sr,
               count(*) OVER () AS sn FROM {src}),
sp AS (SELECT uid, CASE WHEN sr < sn - ceil(sn * 0.1) - ceil((sn - ceil(sn * 0.1)) * 0.1) THEN 'tr'
                        WHEN sr < sn - ceil(sn * 0.1) THEN 'va' ELSE 'te' END AS split FROM sp0)"""


# ------------------------------------------------------------------ E1, E2

@register("auc", f"""
WITH {sql_scored(params_binary())}, {_sql_split('sc')},
s AS (SELECT split, 1 / (1 + exp(-z[1])) AS p, y FROM sc JOIN sp USING (uid)),
g AS (SELECT split, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY split, p),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT split, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
       round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc
FROM r GROUP BY split
""")
def auc_q(spark, sf_dir):
    """Exact ROC AUC (ties count one half) of the binary head, per split."""
    s = scored_split(spark, sf_dir, params_binary()).select(
        "split", "y", model.predict_binary(F.col("z")[0]).alias("p"))
    a = evaluate.auc(s, "p", "y", by=("split",))
    return a.select("split", "n_pos", "n_neg", round6("auc").alias("auc"))


@register("macro_f1", f"""
WITH {sql_scored(params_class())}, {_sql_split('sc')},
s AS (SELECT split, cls, (list_position(z, list_max(z)) - 1)::INTEGER AS pred FROM sc JOIN sp USING (uid)),
c AS (SELECT split, cls AS k, count(*) AS t, 0 AS p, count_if(cls = pred) AS tp FROM s GROUP BY split, cls
      UNION ALL
      SELECT split, pred AS k, 0 AS t, count(*) AS p, 0 AS tp FROM s GROUP BY split, pred),
per AS (SELECT split, k, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM c GROUP BY split, k)
SELECT split, round(avg(2.0 * tp / (t + p)), 6) AS macro_f1, count(*)::BIGINT AS classes FROM per GROUP BY split
""")
def macro_f1_q(spark, sf_dir):
    """Macro-F1 of the 3-class head (argmax), per split; classes = seen in truth or prediction."""
    s = scored_split(spark, sf_dir, params_class()).select("split", "cls", model.predict_class("z").alias("pred"))
    m = evaluate.macro_f1(s, "cls", "pred", by=("split",))
    return m.select("split", round6("macro_f1").alias("macro_f1"), F.col("classes").cast("long"))


# ------------------------------------------------------------------ W7, W8

def epoch_scores(spark, sf_dir):
    """(run_id, epoch, score): event type, day since the first day, mean value (9 digits)."""
    ev = read_table(spark, sf_dir, "events")
    day = F.to_date("ts")
    d0 = ev.agg(F.min(day).alias("d0")).first()["d0"]     # one scalar
    return ev.groupBy(F.col("event_type").alias("run_id"),
                      F.datediff(day, F.lit(d0)).alias("epoch")).agg(
        round_to(F.avg("value"), 9).alias("score"))


SQL_EPOCHS = """
d0 AS (SELECT min(ts::DATE) AS d0 FROM events),
ep AS (SELECT event_type AS run_id, (ts::DATE - d0)::INTEGER AS epoch, round(avg(value), 9) AS score
       FROM events, d0 GROUP BY run_id, epoch),
mk AS (SELECT *, (score > coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INTEGER AS improved,
              row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1 AS pos FROM ep)"""


@register("best_epoch", f"""
WITH {SQL_EPOCHS}
SELECT run_id, max(CASE WHEN improved = 1 THEN epoch END) AS best_epoch, max(score) AS best_score,
       sum(improved)::BIGINT AS improvements, count(*)::BIGINT AS epochs
FROM mk GROUP BY run_id
""")
def best_epoch_q(spark, sf_dir):
    """Per run the epoch whose score is strictly above all earlier ones, last such (first maximum)."""
    return evaluate.best_epoch(epoch_scores(spark, sf_dir))


@register("early_stop", f"""
WITH {SQL_EPOCHS},
w AS (SELECT *, pos - coalesce(max(CASE WHEN improved = 1 THEN pos END) OVER (PARTITION BY run_id ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS waiting FROM mk),
st AS (SELECT run_id, min(CASE WHEN waiting > {PATIENCE} THEN pos END) AS stop FROM w GROUP BY run_id),
k AS (SELECT w.*, st.stop FROM w JOIN st USING (run_id) WHERE st.stop IS NULL OR w.pos <= st.stop),
agg AS (SELECT run_id, max(CASE WHEN pos = stop THEN epoch END) AS stop_epoch, count(*)::BIGINT AS epochs_run,
               max(CASE WHEN improved = 1 THEN pos END) AS bpos FROM k GROUP BY run_id)
SELECT agg.run_id, stop_epoch, epochs_run, k.epoch AS best_epoch, k.score AS best_score
FROM agg LEFT JOIN k ON k.run_id = agg.run_id AND k.pos = agg.bpos
""")
def early_stop_q(spark, sf_dir):
    """Stop at the first epoch whose wait since the last improvement exceeds the patience (2)."""
    return evaluate.early_stop(epoch_scores(spark, sf_dir), PATIENCE)


SNAPSHOT_EPOCHS = 3


def _snapshot(epoch: int):
    return model.rule_params(list(WIDTHS), DIM, 1, salt=epoch)


def _sql_snapshot_scores() -> str:
    epochs = [f"SELECT * FROM (WITH {sql_scored(_snapshot(e))} SELECT {e}::INTEGER AS epoch, uid, y, z[1] AS z FROM sc)"
              for e in range(SNAPSHOT_EPOCHS)]
    return f"""
WITH every AS ({" UNION ALL ".join(epochs)}), {_sql_split('(SELECT uid FROM every WHERE epoch = 0)')},
loss AS (SELECT epoch, round(avg(y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))), 9) AS loss
         FROM every JOIN sp USING (uid) WHERE split = 'va' GROUP BY epoch),
best AS (SELECT epoch FROM loss ORDER BY loss, epoch LIMIT 1)
SELECT uid, epoch, round(1 / (1 + exp(-z)), 6) AS score
FROM every JOIN sp USING (uid) JOIN best USING (epoch) WHERE split = 'te'
"""


@register("best_snapshot_score", _sql_snapshot_scores())
def best_snapshot_score(spark, sf_dir):
    """S10 + W7: three stored snapshots; the one with the lowest validation loss scores the test rows.

    Weights are rows that meet the data in a join; the best epoch is picked in the same plan.
    """
    star = build_star(spark, sf_dir)
    split = seeded_split(star.labels, "uid", (0.1, 0.1), ("tr", "va", "te"), seed=SPLIT_SEED).filter("split <> 'tr'")
    rows = aligned(star, split).withColumn("run_id", F.lit("star"))
    models = model.snapshot_models(reduce(DataFrame.unionByName, (
        params_frame(spark, dict(_snapshot(e).flat()), "star", e) for e in range(SNAPSHOT_EPOCHS))))
    loss = model.score_snapshots(rows.filter("split = 'va'"), models, len(WIDTHS)).groupBy("run_id", "epoch").agg(
        round_to(F.avg(model.bce_row(F.col("z")[0], F.col("y"), 1.0)), 9).alias("score"))
    best = evaluate.best_epoch(loss, higher_is_better=False).select("run_id", F.col("best_epoch").alias("epoch"))
    tested = model.score_snapshots(rows.filter("split = 'te'"), models.join(best, ["run_id", "epoch"]), len(WIDTHS))
    return tested.select("uid", "epoch", round6(model.predict_binary(F.col("z")[0])).alias("score"))


# ------------------------------------------------------------------ A9, A10, E3, U2, S8

def scored_in_epoch(spark, sf_dir, star=None):
    """Scored rows as one epoch sends them: training rows in batches of a seeded permutation,
    validation rows in batches by uid; test rows are not sent while training."""
    star = star or build_star(spark, sf_dir)
    sent = seeded_split(star.labels, "uid", (0.1, 0.1), ("tr", "va", "te"), seed=SPLIT_SEED).filter("split <> 'te'")
    sent = sent.withColumn("_pf_h", F.when(F.col("split") == "tr", md5_order_key(SEED, "uid")))
    al = aligned(star, assign_batches(sent, ["_pf_h", "uid"], BATCH, partition_by=["split"]).drop("_pf_h"))
    return model.head(model.embed(al, params_binary(), list(WIDTHS), "relu"), params_binary())


SQL_EPOCH_BATCHES = f"""{_sql_split('al')},
bt0 AS (SELECT al.*, split, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'tr'
                 THEN md5('{SEED}:' || uid::VARCHAR) END, uid) - 1 AS r, count(*) OVER (PARTITION BY split) AS n
        FROM al JOIN sp USING (uid) WHERE split <> 'te'),
bt AS (SELECT *, r // {BATCH} AS batch_id, least({BATCH}, n - (r // {BATCH}) * {BATCH}) AS S FROM bt0)"""


def party_run_counts(spark, sf_dir, star=None):
    """(split, party, batch_id, samples, dims, nnz, heads, tails): column-major runs of every
    party's ReLU embedding per batch of an epoch; one shuffle on (split, party, batch)."""
    sc = scored_in_epoch(spark, sf_dir, star)
    parts = F.array(*[F.struct(F.lit(p).alias("party"), F.col(f"e{p}").alias("e")) for p in PARTIES])
    cells = sc.select("split", "batch_id", "row_in_batch", "batch_rows", F.explode(parts).alias("pe")).select(
        "split", "batch_id", "row_in_batch", "batch_rows", F.col("pe.party").alias("party"), F.col("pe.e").alias("e"))
    return codec.run_counts(codec.batch_matrix(cells, "e", keys=("split", "party", "batch_id")))


def epoch_messages(counts, codecs):
    """Sizes of an epoch's messages: embeddings of both splits are sent, gradients come back for
    training batches only."""
    sizes = codec.codec_sizes(counts, codecs=codecs, k=GRID_K).withColumn(
        "direction", F.when(F.col("direction") == "emb", F.lit("send")).otherwise(F.lit("receive")))
    return sizes.filter("split = 'tr' or direction = 'send'")


SQL_PARTY_COUNTS = f"""
pc AS (SELECT split, batch_id, S, r - batch_id * {BATCH} AS i, p::INTEGER AS party, unnest(range(0, {DIM})) AS d,
              unnest(CASE p WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END) AS v
       FROM sc, range(0, 3) t(p)),
prn AS (SELECT split, party, batch_id, S, v <> 0 AS nz,
              lag(v <> 0) OVER (PARTITION BY split, party, batch_id ORDER BY d * S + i) AS pnz FROM pc),
counts AS (SELECT split, party, batch_id, max(S) AS S, {DIM} AS dims, count_if(nz) AS nnz,
                  count_if(nz AND coalesce(NOT pnz, true)) AS heads,
                  count_if(NOT nz AND coalesce(pnz, false)) AS tails
           FROM prn GROUP BY split, party, batch_id)"""


def sql_codec_bits(c: str, d: str, k: int) -> str:
    q0, q1, q2 = sql_ceil_log2("S"), sql_ceil_log2("dims"), sql_ceil_log2("S * dims")
    dense = {"org": 32, "int": 32, "q16": 16, "q8": 8, "q4": 4}
    width = 16 if c.endswith("16") else 32
    if c in dense:
        return f"{dense[c]} * S * dims"
    if d == "emb":
        return f"nnz * {width} + (heads + tails) * {q2} + {q0} + {q1}"
    if c.startswith("svfl"):
        return f"nnz * {width} + {q0} + {q1}"
    keep = f"least({k}, S * dims)"
    return f"{keep} * {q2} + {keep} * {width} + {q0} + {q1}"


@register("comm_totals", f"""
WITH {sql_scored(params_binary(), batch_sql=SQL_EPOCH_BATCHES)}, {SQL_PARTY_COUNTS},
m AS (SELECT party, 'send' AS direction, {sql_bytes(sql_codec_bits('svfl16', 'emb', GRID_K))} AS bytes FROM counts
      UNION ALL
      SELECT party, 'receive', {sql_bytes(sql_codec_bits('svfl16', 'grad', GRID_K))} FROM counts WHERE split = 'tr'),
g AS (SELECT party, direction, count(*)::BIGINT AS messages, sum(bytes)::BIGINT AS bytes
      FROM m GROUP BY ROLLUP (party, direction))
SELECT party, direction, messages, bytes, round(bytes / messages / 1024.0, 6) AS kib_per_message,
       round(bytes / 1073741824.0, 9) AS gib
FROM g
""")
def comm_totals_q(spark, sf_dir):
    """svfl16 messages of one epoch (training both ways, validation sent): count and
    bytes per party and direction, per party and in total (rollup), mean KiB per message and GiB."""
    sizes = epoch_messages(party_run_counts(spark, sf_dir), ("svfl16",))
    t = evaluate.comm_totals(sizes, ("party", "direction"))
    return t.select("party", "direction", "messages", "bytes", round6("kib_per_message").alias("kib_per_message"),
                    round_to("gib", 9).alias("gib"))


RUN_CODECS = codec.CODECS


def _sql_run_log() -> str:
    sparse_rows = []
    for c in RUN_CODECS:
        for d, dname in (("emb", "send"), ("grad", "receive")):
            sparse_rows.append(f"SELECT '{c}' AS codec, party, '{dname}' AS direction, "
                               f"{sql_bytes(sql_codec_bits(c, d, GRID_K))} AS bytes FROM counts"
                               + (" WHERE split = 'tr'" if d == "grad" else ""))
    sel = ", ".join(f"sum(CASE WHEN direction = '{d}' AND party = {p} THEN bytes END)::BIGINT AS total_size_{d}_{p}"
                    for d in ("send", "receive") for p in PARTIES)
    bits = {"org": 32, "q16": 16, "q8": 8, "q4": 4}
    oneshot = " UNION ALL ".join(
        f"SELECT 'pca_{c}' AS run_id, 'pca' AS compress, '{c}' AS codec, p AS party, "
        f"{sql_bytes(f'n * {DIM} * {bits[c]}')} AS bytes FROM ns, range(0, 3) t(p)" for c in ONESHOT_CODECS)
    osel = ", ".join(f"sum(CASE WHEN party = {p} THEN bytes END)::BIGINT AS total_size_send_{p}" for p in PARTIES)
    return f"""
WITH {sql_scored(params_binary(), batch_sql=SQL_EPOCH_BATCHES)}, {SQL_PARTY_COUNTS},
ns AS (SELECT split, count(*) AS n FROM sp WHERE split <> 'te' GROUP BY split),
m AS ({' UNION ALL '.join(sparse_rows)}),
sparse AS (SELECT 'svfl_' || codec AS run_id, NULL::VARCHAR AS compress, codec, {BATCH} AS batch_size, {DIM} AS interface_dims,
                  {GRID_K} AS top_k, {LAMBDA}::DOUBLE AS sparse_embed_lambda, {sel} FROM m GROUP BY codec),
os AS ({oneshot}),
one AS (SELECT run_id, compress, codec, {osel} FROM os GROUP BY run_id, compress, codec)
SELECT run_id, compress, codec, batch_size, interface_dims, top_k, sparse_embed_lambda,
       {", ".join(f"total_size_{d}_{p}" for d in ("send", "receive") for p in PARTIES)},
       {" + ".join(f"coalesce(total_size_{d}_{p}, 0)" for d in ("send", "receive") for p in PARTIES)} AS total_size_all
FROM sparse
UNION ALL
SELECT run_id, compress, codec, NULL, {DIM}, NULL, NULL,
       {", ".join(f"total_size_send_{p}" for p in PARTIES)}, {", ".join("NULL" for _ in PARTIES)},
       {" + ".join(f"total_size_send_{p}" for p in PARTIES)}
FROM one
"""


@register("run_log", _sql_run_log())
def run_log_q(spark, sf_dir):
    """One run record per codec of the sparse grid (bytes of one epoch per party and
    direction as columns, from one pass over the party embeddings), unioned by name with the one-shot grid
    (training and validation splits sent once, no replies), whose records lack the sparse-only
    columns."""
    star = build_star(spark, sf_dir)
    sizes = epoch_messages(party_run_counts(spark, sf_dir, star), RUN_CODECS)
    sparse = evaluate.run_record(sizes.withColumn("run_id", F.concat(F.lit("svfl_"), F.col("codec"))),
                                 ["run_id", "codec"], list(PARTIES))
    sparse = (sparse.withColumn("batch_size", F.lit(BATCH)).withColumn("interface_dims", F.lit(DIM))
              .withColumn("top_k", F.lit(GRID_K)).withColumn("sparse_embed_lambda", F.lit(LAMBDA)))
    # one-shot runs: the training and validation splits are sent once as dense (rows x dims)
    # matrices (test codes are not counted); split sizes follow from the row count alone
    # (same cuts as seeded_split)
    n = F.col("n_all").cast("double")
    te = F.ceil(n * 0.1)
    va = F.ceil((n - te) * 0.1)
    ns = star.labels.agg(F.count(F.lit(1)).alias("n_all")).select(
        F.explode(F.array((n - te - va).cast("long"), va.cast("long"))).alias("n"))
    bits = {"org": 32, "q16": 16, "q8": 8, "q4": 4}
    grid = F.array(*[F.struct(F.lit(c).alias("codec"), F.lit(bits[c]).alias("bits"), F.lit(p).alias("party"))
                     for c in ONESHOT_CODECS for p in PARTIES])
    os_sizes = ns.select("n", F.explode(grid).alias("g")).select(
        F.concat(F.lit("pca_"), F.col("g.codec")).alias("run_id"), F.col("g.codec").alias("codec"),
        F.col("g.party").alias("party"), F.lit("send").alias("direction"),
        F.floor((F.col("n") * DIM * F.col("g.bits") + 7) / 8).cast("long").alias("bytes"))
    one = evaluate.run_record(os_sizes, ["run_id", "codec"], list(PARTIES), directions=("send",))
    one = one.withColumn("compress", F.lit("pca")).withColumn("interface_dims", F.lit(DIM))
    runs = sparse.unionByName(one, allowMissingColumns=True)
    cols = (["run_id", "compress", "codec", "batch_size", "interface_dims", "top_k", "sparse_embed_lambda"]
            + [f"total_size_{d}_{p}" for d in ("send", "receive") for p in PARTIES] + ["total_size_all"])
    return runs.select(*cols)


@register("metric_log", f"""
WITH {sql_scored(params_binary(), batch_sql=SQL_EPOCH_BATCHES)}, {SQL_POS_WEIGHT},
b AS (SELECT batch_id, avg({SQL_BCE}) AS loss,
             {LAMBDA} / 3.0 * ({" + ".join(f"avg(list_sum(list_transform(e{q}, lambda v: abs(v))))" for q in range(3))}) AS pen,
             sum({" + ".join(f"len(list_filter(e{q}, lambda v: abs(v) <= 0))" for q in range(3))})
               / (count(*) * {3 * DIM}) AS sparsity
      FROM sc, pw WHERE split = 'tr' GROUP BY batch_id)
SELECT 'star_relu' AS run_id, 'tr/loss' AS tag, batch_id AS step, round(loss, 6) AS value FROM b
UNION ALL SELECT 'star_relu', 'reg/tr_sparse_embed_loss_x_lambda', batch_id, round(pen, 6) FROM b
UNION ALL SELECT 'star_relu', 'reg/tr_embed_sparsity', batch_id, round(sparsity, 6) FROM b
""")
def metric_log_q(spark, sf_dir):
    """Per-step metric rows (run_id, tag, step, value) from one pass over the training batches."""
    star = build_star(spark, sf_dir)
    pw = fit_pos_weight(spark, sf_dir, star)
    sc = scored_in_epoch(spark, sf_dir, star).filter("split = 'tr'")
    zero = sum((F.size(F.filter(f"e{q}", lambda v: F.abs(v) <= 0)) for q in range(3)), F.lit(0))
    b = sc.groupBy("batch_id").agg(
        F.avg(model.bce_row(F.col("z")[0], F.col("y"), pw)).alias("loss"),
        F.avg(model.penalty_rows([DIM] * 3, 1, LAMBDA)).alias("pen"),
        (F.sum(zero) / (F.count(F.lit(1)) * 3 * DIM)).alias("sparsity"))
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).alias("value")) for t, c in (
        ("tr/loss", "loss"), ("reg/tr_sparse_embed_loss_x_lambda", "pen"), ("reg/tr_embed_sparsity", "sparsity"))])
    return b.select(F.lit("star_relu").alias("run_id"), F.col("batch_id").alias("step"),
                    F.explode(tags).alias("t")).select("run_id", "t.tag", "step", round6("t.value").alias("value"))
