"""Codec queries over ``embeddings``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from partyframe.functions.numeric import fp16_round, round6, round_to
from partyframe.operators import codec, payload
from partyframe.operators.index import dense_index
from partyframe.plans.inputs import (SQL_EMB_BATCHES, TOPK, embedding_batches, relu_array, sql_bytes,
                                     sql_ceil_log2, sql_fp16)
from partyframe.plans.registry import register
from partyframe.sources.tables import read_table


def _runs_sql(pos: str) -> str:
    return f"""
runs AS (
  SELECT batch_id, S, dims, {pos} AS pos, v <> 0 AS nz,
         lag(v <> 0) OVER (PARTITION BY batch_id ORDER BY {pos}) AS pnz
  FROM cells),
counts AS (
  SELECT batch_id, max(S) AS S, max(dims) AS dims, count_if(nz) AS nnz,
         count_if(nz AND coalesce(NOT pnz, true)) AS heads,
         count_if(NOT nz AND coalesce(pnz, false)) AS tails
  FROM runs GROUP BY batch_id)"""


def _counts(spark, sf_dir, axis=1):
    b = embedding_batches(spark, sf_dir)
    mat = codec.batch_matrix(b, "e", keys=("batch_id",), axis=axis)
    return codec.run_counts(mat)


# ---------------------------------------------------------------- minimum slice

SQL_CODEC_SIZE_BY_BATCH = f"""
WITH {SQL_EMB_BATCHES}, {_runs_sql('pos_col')}
SELECT batch_id, S::BIGINT AS samples, nnz::BIGINT AS nnz, heads::BIGINT AS heads, tails::BIGINT AS tails,
       {sql_bytes('32 * S * dims')}::BIGINT AS bytes_org,
       {sql_bytes(f"16 * nnz + (heads + tails) * {sql_ceil_log2('S * dims')} + {sql_ceil_log2('S')} + {sql_ceil_log2('dims')}")}::BIGINT AS bytes_svfl16
FROM counts
"""


@register("codec_size_by_batch", SQL_CODEC_SIZE_BY_BATCH)
def codec_size_by_batch(spark, sf_dir):
    """ReLU embeddings, batches of 128 in vec_id order, column-major runs; bytes for svfl16 beside org."""
    c = _counts(spark, sf_dir, axis=1)
    return c.select(
        "batch_id", F.col("samples").cast("long").alias("samples"), "nnz", "heads", "tails",
        codec.message_bytes("org", "emb", "samples", "dims").alias("bytes_org"),
        codec.message_bytes("svfl16", "emb", "samples", "dims", "nnz", "heads", "tails").alias("bytes_svfl16"))


# ---------------------------------------------------------------- runs tables

def _runs_table_sql(pos: str) -> str:
    return f"""
WITH {SQL_EMB_BATCHES}, {_runs_sql(pos)},
hd AS (SELECT batch_id, pos AS head, row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS run
       FROM runs WHERE nz AND coalesce(NOT pnz, true)),
tl AS (SELECT batch_id, pos AS tail, row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS run
       FROM runs WHERE NOT nz AND coalesce(pnz, false))
SELECT hd.batch_id, hd.run::BIGINT AS run, hd.head::BIGINT AS head,
       coalesce(tl.tail, c.S * c.dims)::BIGINT AS run_end, (tl.tail IS NOT NULL)::INTEGER AS has_tail
FROM hd LEFT JOIN tl ON hd.batch_id = tl.batch_id AND hd.run = tl.run
JOIN counts c ON c.batch_id = hd.batch_id
"""


def _runs_table(spark, sf_dir, axis):
    b = embedding_batches(spark, sf_dir)
    msg = codec.rle_encode(codec.batch_matrix(b, "e", axis=axis))
    z = msg.select("batch_id", "samples", "dims",
                   F.posexplode(F.arrays_zip("head", "tail")).alias("run", "ht"))
    end = F.col("samples").cast("long") * F.col("dims")
    return z.select("batch_id", F.col("run").cast("long").alias("run"),
                    F.col("ht.head").cast("long").alias("head"),
                    F.coalesce(F.col("ht.tail").cast("long"), end).alias("run_end"),
                    F.col("ht.tail").isNotNull().cast("int").alias("has_tail"))


@register("rle_col", _runs_table_sql("pos_col"))
def rle_col(spark, sf_dir):
    """C1 column-major: one row per run: head, exclusive end, and whether a tail is sent (an open last run has none)."""
    return _runs_table(spark, sf_dir, axis=1)


@register("rle_row", _runs_table_sql("pos_row"))
def rle_row(spark, sf_dir):
    """C1 row-major (axis=0)."""
    return _runs_table(spark, sf_dir, axis=0)


# ---------------------------------------------------------------- round trips

def _roundtrip(spark, sf_dir, half: bool, axis: int = 1):
    b = embedding_batches(spark, sf_dir)
    msg = codec.rle_encode(codec.batch_matrix(b, "e", axis=axis), half=half)
    dec = codec.decode_to_rows(msg, ["batch_id"], kind="rle", axis=axis)
    expect = F.transform("e", lambda v: fp16_round(v).cast("float")) if half else F.col("e")
    j = b.select("batch_id", "row_in_batch", expect.alias("x")).join(dec, ["batch_id", "row_in_batch"])
    same = F.size(F.filter(F.arrays_zip("x", "decoded"), lambda z: z["x"] == z["decoded"]))
    return j.groupBy("batch_id").agg(
        F.sum(F.size("x")).cast("long").alias("cells"),
        F.sum(same).cast("long").alias("equal_cells"),
        round6(F.sum(F.aggregate("decoded", F.lit(0.0), lambda a, v: a + v))).alias("sum_decoded"))


def _roundtrip_sql(half: bool) -> str:
    v = sql_fp16("v") if half else "v::DOUBLE"
    return f"""
WITH {SQL_EMB_BATCHES}
SELECT batch_id, count(*)::BIGINT AS cells, count(*)::BIGINT AS equal_cells,
       round(sum({v}), 6) AS sum_decoded
FROM cells GROUP BY batch_id
"""


@register("rle_roundtrip", _roundtrip_sql(False))
def rle_roundtrip(spark, sf_dir):
    """C1 -> C2: decode(encode(x)) = x on every cell."""
    return _roundtrip(spark, sf_dir, half=False)


@register("rle16_roundtrip", _roundtrip_sql(True))
def rle16_roundtrip(spark, sf_dir):
    """C3 -> C4: decode(encode16(x)) = fp16(x) on every cell."""
    return _roundtrip(spark, sf_dir, half=True)


@register("rle_row_roundtrip", _roundtrip_sql(False))
def rle_row_roundtrip(spark, sf_dir):
    """C1 -> C2 on the row-major layout (axis=0)."""
    return _roundtrip(spark, sf_dir, half=False, axis=0)


# ---------------------------------------------------------------- fp16

@register("fp16_round", f"""
WITH {SQL_EMB_BATCHES}
SELECT vec_id, round(sum({sql_fp16('rv')}), 6) AS sum_fp16,
       count_if({sql_fp16('rv')} <> rv::DOUBLE)::BIGINT AS changed
FROM cells GROUP BY vec_id
""")
def fp16_round_q(spark, sf_dir):
    """Round the signed embedding values to the binary16 grid."""
    b = embedding_batches(spark, sf_dir)
    h = F.transform("raw", lambda v: fp16_round(v))
    return b.select("vec_id", h.alias("h"), "raw").select(
        "vec_id",
        round6(F.aggregate("h", F.lit(0.0), lambda a, v: a + v)).alias("sum_fp16"),
        F.size(F.filter(F.arrays_zip("h", "raw"), lambda z: z["h"] != z["raw"].cast("double")))
        .cast("long").alias("changed"))


# ---------------------------------------------------------------- quantisers

def _q_query(spark, sf_dir, levels: int, direction: str):
    b = embedding_batches(spark, sf_dir)
    src = "e" if direction == "emb" else "raw"   # ReLU output for embeddings, signed values as gradients
    mat = codec.batch_matrix(b, src).withColumn("orig", F.col("flat"))
    if direction == "emb":
        msg = codec.q_embed_decode(codec.q_embed_encode(mat, levels), levels)
        extra = ["scale"]
    else:
        msg = codec.q_grad_decode(codec.q_grad_encode(mat, levels), levels)
        extra = ["lo", "hi"]
    err = F.array_max(F.transform(F.arrays_zip("decoded", "orig"),
                                  lambda z: F.abs(z["decoded"] - z["orig"].cast("double"))))
    codes = F.col("codes")
    return msg.select(
        "batch_id", *[round6(c).alias(c) for c in extra],
        F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c.cast("long")).alias("sum_codes"),
        F.aggregate(codes, F.lit(0).cast("long"),
                    lambda a, c: a + c.cast("long") * c.cast("long")).alias("sum_sq_codes"),
        round6(err).alias("max_err"))


def _q_sql(levels: int, direction: str) -> str:
    mult = "255.0" if levels == 256 else f"{float(levels)}"
    top = levels - 1
    if direction == "emb":
        x, stats = "v", "max(v::DOUBLE) OVER (PARTITION BY batch_id) AS scale"
        code = f"CASE WHEN scale > 0 THEN least(greatest(floor(x / scale * {mult}), 0), {top}) ELSE 0 END"
        dec = f"code * scale / {mult}"
        extra = "round(max(scale), 6) AS scale"
    else:
        x = "rv"
        stats = ("min(rv::DOUBLE) OVER (PARTITION BY batch_id) AS lo, "
                 "max(rv::DOUBLE) OVER (PARTITION BY batch_id) AS hi")
        code = (f"CASE WHEN hi - lo > 0 THEN least(greatest(floor((x - lo) / (hi - lo) * {mult}), 0), {top}) "
                f"ELSE 0 END")
        dec = f"code * (hi - lo) / {mult} + lo"
        extra = "round(max(lo), 6) AS lo, round(max(hi), 6) AS hi"
    cols = "scale" if direction == "emb" else "lo, hi"
    return f"""
WITH {SQL_EMB_BATCHES},
s AS (SELECT batch_id, {x}::DOUBLE AS x, {stats} FROM cells),
c AS (SELECT batch_id, x, {cols}, ({code})::BIGINT AS code FROM s)
SELECT batch_id, {extra}, sum(code)::BIGINT AS sum_codes, sum(code * code)::BIGINT AS sum_sq_codes,
       round(max(abs(({dec}) - x)), 6) AS max_err
FROM c GROUP BY batch_id
"""


@register("q8_embed", _q_sql(256, "emb"))
def q8_embed(spark, sf_dir):
    """8-bit embedding codes, scale = batch max (A6); decode error <= scale/255."""
    return _q_query(spark, sf_dir, 256, "emb")


@register("q4_embed", _q_sql(16, "emb"))
def q4_embed(spark, sf_dir):
    """4-bit embedding codes (x16, clamped to 15)."""
    return _q_query(spark, sf_dir, 16, "emb")


@register("q8_grad", _q_sql(256, "grad"))
def q8_grad(spark, sf_dir):
    """8-bit affine gradient codes between batch min and max."""
    return _q_query(spark, sf_dir, 256, "grad")


@register("q4_grad", _q_sql(16, "grad"))
def q4_grad(spark, sf_dir):
    """4-bit affine gradient codes."""
    return _q_query(spark, sf_dir, 16, "grad")


# ---------------------------------------------------------------- top-k

def _topk(spark, sf_dir, half: bool):
    b = embedding_batches(spark, sf_dir)
    msg = codec.topk_encode(codec.batch_matrix(b, "raw", axis=0), TOPK, half=half)
    z = msg.select("batch_id", F.explode(F.arrays_zip("idx", "val")).alias("kv"))
    return z.select("batch_id", F.col("kv.idx").cast("long").alias("pos"), round6(F.col("kv.val")).alias("val"))


def _topk_sql(half: bool) -> str:
    val = sql_fp16("rv") if half else "rv::DOUBLE"
    return f"""
WITH {SQL_EMB_BATCHES},
r AS (SELECT batch_id, pos_row, rv,
             row_number() OVER (PARTITION BY batch_id ORDER BY abs(rv::DOUBLE) DESC, pos_row DESC) AS rk
      FROM cells)
SELECT batch_id, pos_row::BIGINT AS pos, round({val}, 6) AS val FROM r WHERE rk <= {TOPK}
"""


@register("topk_grad", _topk_sql(False))
def topk_grad(spark, sf_dir):
    """Top-k (k=100) gradient cells by magnitude per batch, row-major positions."""
    return _topk(spark, sf_dir, half=False)


@register("topk16_grad", _topk_sql(True))
def topk16_grad(spark, sf_dir):
    """Top-k with fp16 values."""
    return _topk(spark, sf_dir, half=True)


@register("topk_roundtrip", f"""
WITH {SQL_EMB_BATCHES},
r AS (SELECT batch_id, rv,
             row_number() OVER (PARTITION BY batch_id ORDER BY abs(rv::DOUBLE) DESC, pos_row DESC) AS rk
      FROM cells)
SELECT batch_id, count(*)::BIGINT AS cells, count_if(rk <= {TOPK})::BIGINT AS kept,
       round(sum(CASE WHEN rk <= {TOPK} THEN rv::DOUBLE ELSE 0 END), 6) AS sum_decoded
FROM r GROUP BY batch_id
""")
def topk_roundtrip(spark, sf_dir):
    """C9 decode: scatter the kept cells into a zero batch; count kept and sum."""
    b = embedding_batches(spark, sf_dir)
    msg = codec.topk_encode(codec.batch_matrix(b, "raw", axis=0), TOPK)
    dec = codec.decode_to_rows(msg, ["batch_id"], kind="topk")
    return dec.groupBy("batch_id").agg(
        F.sum(F.size("decoded")).cast("long").alias("cells"),
        F.sum(F.size(F.filter("decoded", lambda v: v != 0))).cast("long").alias("kept"),
        round6(F.sum(F.aggregate("decoded", F.lit(0.0), lambda a, v: a + v))).alias("sum_decoded"))


# ---------------------------------------------------------------- masked gradient

@register("masked_grad", f"""
WITH {SQL_EMB_BATCHES},
g AS (SELECT c1.batch_id, c1.S, c1.dims, c1.v AS ev, c2.rv AS gv
      FROM cells c1 JOIN cells c2
        ON c1.batch_id = c2.batch_id AND c1.dd = c2.dd AND c2.i = (c1.i + 1) % c1.S)
SELECT batch_id, count_if(ev <> 0)::BIGINT AS n_vals,
       round(sum(CASE WHEN ev <> 0 THEN gv::DOUBLE ELSE 0 END), 6) AS sum_vals,
       {sql_bytes(f"16 * count_if(ev <> 0) + {sql_ceil_log2('max(S)')} + {sql_ceil_log2('max(dims)')}")}::BIGINT
         AS bytes_svfl16
FROM g GROUP BY batch_id
""")
def masked_grad(spark, sf_dir):
    """The gradient travels as values only, at the embedding's non-zero positions.

    Gradient of row i = signed embedding of row (i+1) mod S of the same batch.
    Both matrices are built in the same shuffle, so the mask needs no join.
    """
    b = embedding_batches(spark, sf_dir)
    b = b.withColumn("gi", ((F.col("row_in_batch") + F.col("batch_rows") - 1) % F.col("batch_rows")).cast("int"))
    mat = codec.batch_matrix(b, {"flat": ("e", "row_in_batch"), "gflat": ("raw", "gi")})
    vals = codec.masked_values(F.col("gflat"), F.col("flat"))
    m = mat.withColumn("vals", vals).withColumn("nnz", F.size(codec.nonzero_values(F.col("flat"))))
    return m.select(
        "batch_id", F.size("vals").cast("long").alias("n_vals"),
        round6(F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)).alias("sum_vals"),
        codec.message_bytes("svfl16", "grad", "samples", "dims", "nnz").alias("bytes_svfl16"))


# ---------------------------------------------------------------- sweep

SWEEP_K = 1024


def _sweep_sql() -> str:
    parts = []
    q0, q1, q2 = sql_ceil_log2("S"), sql_ceil_log2("dims"), sql_ceil_log2("S * dims")
    dense = {"org": 32, "int": 32, "q16": 16, "q8": 8, "q4": 4}
    for c in codec.CODECS:
        for d in ("emb", "grad"):
            width = 16 if c.endswith("16") else 32
            if c in dense:
                bits = f"{dense[c]} * S * dims"
            elif d == "emb":
                bits = f"nnz * {width} + (heads + tails) * {q2} + {q0} + {q1}"
            elif c.startswith("svfl"):
                bits = f"nnz * {width} + {q0} + {q1}"
            else:
                keep = f"least({SWEEP_K}, S * dims)"
                bits = f"{keep} * {q2} + {keep} * {width} + {q0} + {q1}"
            parts.append(f"SELECT batch_id, '{c}' AS codec, '{d}' AS direction, "
                         f"{sql_bytes(bits)}::BIGINT AS bytes FROM counts")
    return f"WITH {SQL_EMB_BATCHES}, {_runs_sql('pos_col')}\n" + "\nUNION ALL\n".join(parts)


@register("codec_sweep", _sweep_sql())
def codec_sweep(spark, sf_dir):
    """Bytes of every codec in both directions for every batch, in one job."""
    c = _counts(spark, sf_dir, axis=1)
    return codec.codec_sizes(c, k=SWEEP_K).select("batch_id", "codec", "direction", "bytes")


# ---------------------------------------------------------------- sparsity

EPS_GRID = (0.0, 0.01, 0.05, 0.1)


@register("sparsity", f"""
WITH {SQL_EMB_BATCHES}
SELECT label, eps, count_if(abs(v::DOUBLE) <= eps)::BIGINT AS sparse_cells, count(*)::BIGINT AS cells,
       count_if(abs(v::DOUBLE) <= eps) / count(*) AS sparsity
FROM cells, (VALUES {", ".join(f"({e})" for e in EPS_GRID)}) t(eps)
GROUP BY label, eps
""")
def sparsity_q(spark, sf_dir):
    """Share of ReLU embedding cells with |v| <= eps, per label, for an eps grid in one pass."""
    b = embedding_batches(spark, sf_dir)
    return codec.sparsity(b, "e", EPS_GRID, by=("label",)).withColumn(
        "eps", F.col("eps").cast("double"))


# ---------------------------------------------------------------- every codec through the dispatch

def _roundtrip_all_sql() -> str:
    parts = []
    for c in codec.CODECS:
        if c in ("q8", "q4"):
            mult, top = ("255.0", 255) if c == "q8" else ("16.0", 15)
            dec = (f"(CASE WHEN scale > 0 THEN least(greatest(floor(v::DOUBLE / scale * {mult}), 0), {top}) "
                   f"* scale / {mult} ELSE 0 END)::FLOAT::DOUBLE")
        elif c in ("q16", "svfl16", "topk16"):
            dec = f"({sql_fp16('v')})::FLOAT::DOUBLE"
        else:
            dec = "v::DOUBLE"
        parts.append(f"SELECT '{c}' AS codec, batch_id, count(*)::BIGINT AS cells, "
                     f"round(max(abs({dec} - v::DOUBLE)), 6) AS max_err, round(sum({dec}), 6) AS sum_decoded "
                     f"FROM sc GROUP BY batch_id")
    return (f"WITH {SQL_EMB_BATCHES},\nsc AS (SELECT *, max(v::DOUBLE) OVER (PARTITION BY batch_id) AS scale FROM cells)\n"
            + "\nUNION ALL\n".join(parts))


@register("codec_roundtrip", _roundtrip_all_sql())
def codec_roundtrip(spark, sf_dir):
    """Every codec's encode -> decode of the ReLU embedding batches through the dispatch,
    compared with the input rows: cells, largest error and sum of the decoded values."""
    b = embedding_batches(spark, sf_dir)
    mat = codec.batch_matrix(b, "e", keys=("batch_id",))
    decoded = None
    for c in codec.CODECS:
        d = codec.decode(codec.encode(mat, c, "emb"), c, ["batch_id"]).withColumn("codec", F.lit(c))
        decoded = d if decoded is None else decoded.unionByName(d)
    j = decoded.join(b.select("batch_id", "row_in_batch", "e"), ["batch_id", "row_in_batch"])
    err = F.array_max(F.transform(F.arrays_zip("decoded", "e"),
                                  lambda z: F.abs(z["decoded"].cast("double") - z["e"].cast("double"))))
    return j.groupBy("codec", "batch_id").agg(
        F.sum(F.size("e")).cast("long").alias("cells"),
        round6(F.max(err)).alias("max_err"),
        round6(F.sum(F.aggregate("decoded", F.lit(0.0), lambda a, v: a + v.cast("double")))).alias("sum_decoded"))


def _grad_roundtrip_sql() -> str:
    """What each codec's gradient decodes to, cell by cell, straight from the inputs: the layout must not matter."""
    parts = []
    for c in codec.CODECS:
        value = f"({sql_fp16('rv')})::FLOAT::DOUBLE" if "16" in c else "rv::DOUBLE"
        if c in ("q8", "q4"):
            mult, top = ("255.0", 255) if c == "q8" else ("16.0", 15)
            value = (f"(CASE WHEN hi - lo > 0 THEN least(greatest(floor((rv::DOUBLE - lo) / (hi - lo) * {mult}), 0), {top}) "
                     f"ELSE 0 END * (hi - lo) / {mult} + lo)::FLOAT::DOUBLE")
        elif c.startswith("svfl"):
            value = f"(CASE WHEN v <> 0 THEN {value} ELSE 0 END)"
        elif c.startswith("topk"):
            value = f"(CASE WHEN rk <= {TOPK} THEN {value} ELSE 0 END)"
        parts.append(f"SELECT '{c}' AS codec, axis::INTEGER AS axis, batch_id, count_if({value} <> 0)::BIGINT AS kept, "
                     f"round(sum({value} * ((i * 7 + dd * 13) % 11)), 5) AS placed FROM gc, range(0, 2) a(axis) "
                     f"GROUP BY axis, batch_id")
    return f"""
WITH {SQL_EMB_BATCHES},
gc AS (SELECT *, min(rv::DOUBLE) OVER (PARTITION BY batch_id) AS lo, max(rv::DOUBLE) OVER (PARTITION BY batch_id) AS hi,
              row_number() OVER (PARTITION BY batch_id ORDER BY abs(rv::DOUBLE) DESC, pos_row DESC) AS rk FROM cells)
""" + "\nUNION ALL\n".join(parts)


@register("codec_grad_roundtrip", _grad_roundtrip_sql())
def codec_grad_roundtrip(spark, sf_dir):
    """Every codec's gradient encode -> decode through the dispatch, in both layouts: cells
    kept and a sum weighted by place, so that a value in the wrong cell shows.  The signed
    embeddings stand for the gradient, their ReLU for the embedding whose positions svfl reuses."""
    b = embedding_batches(spark, sf_dir).persist()      # read by all 18 branches
    out = None
    for axis in (0, 1):
        mat = codec.batch_matrix(b, {"eflat": ("e", "row_in_batch"), "flat": ("raw", "row_in_batch")}, axis=axis)
        kept = codec.rle_encode(codec.batch_matrix(b, "e", axis=axis))
        for c in codec.CODECS:
            sent = codec.encode(mat, c, "grad", k=TOPK, emb_flat="eflat", axis=axis)
            d = codec.decode(sent, c, ["batch_id"], "grad", axis=axis, positions=kept).select(
                F.lit(c).alias("codec"), F.lit(axis).alias("axis"), "batch_id", "row_in_batch", "decoded")
            out = d if out is None else out.unionByName(d)
    cell = out.select("codec", "axis", "batch_id", "row_in_batch", F.posexplode("decoded").alias("d", "v"))
    weight = (F.col("row_in_batch") * 7 + F.col("d") * 13) % 11
    return cell.groupBy("codec", "axis", "batch_id").agg(
        F.sum((F.col("v") != 0).cast("long")).alias("kept"),
        round_to(F.sum(F.col("v").cast("double") * weight), 5).alias("placed"))



# ---------------------------------------------------------------- grid: batch size x dims x k x codec

# fixed values: grid of the test query
GRID_BATCHES = (64, 128)
GRID_DIMS = (8, 16, 64)
GRID_KS = (256, 1024, 4096)


def _grid_sql() -> str:
    q0, q1, q2 = sql_ceil_log2("S"), sql_ceil_log2("dims"), sql_ceil_log2("S * dims")
    dense = {"org": 32, "int": 32, "q16": 16, "q8": 8, "q4": 4}
    parts = []
    for c in codec.CODECS:
        for d in ("emb", "grad"):
            width = 16 if c.endswith("16") else 32
            if c in dense:
                bits = f"{dense[c]} * S * dims"
            elif d == "emb":
                bits = f"nnz * {width} + (heads + tails) * {q2} + {q0} + {q1}"
            elif c.startswith("svfl"):
                bits = f"nnz * {width} + {q0} + {q1}"
            else:
                keep = "least(k, S * dims)"
                bits = f"{keep} * {q2} + {keep} * {width} + {q0} + {q1}"
            parts.append(f"SELECT B, dims, k, '{c}' AS codec, '{d}' AS direction, {sql_bytes(bits)} AS bytes "
                         f"FROM counts, (VALUES {', '.join(f'({k})' for k in GRID_KS)}) kk(k)")
    configs = ", ".join(f"({b}, {d})" for b in GRID_BATCHES for d in GRID_DIMS)
    return f"""
WITH eb AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(v, 0::FLOAT)) AS e,
                   row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM embeddings),
cf AS (SELECT eb.*, B, dd AS dims, idx // B AS batch_id, idx % B AS i, least(B, n - (idx // B) * B) AS S
       FROM eb, (VALUES {configs}) g(B, dd)),
cells AS (SELECT B, dims, batch_id, i, S, unnest(range(0, dims)) AS d, unnest(e[1:dims]) AS v FROM cf),
runs AS (SELECT B, dims, batch_id, S, v <> 0 AS nz,
                lag(v <> 0) OVER (PARTITION BY B, dims, batch_id ORDER BY d * S + i) AS pnz FROM cells),
counts AS (SELECT B, dims, batch_id, max(S) AS S, count_if(nz) AS nnz,
                  count_if(nz AND coalesce(NOT pnz, true)) AS heads,
                  count_if(NOT nz AND coalesce(pnz, false)) AS tails
           FROM runs GROUP BY B, dims, batch_id),
sz AS ({' UNION ALL '.join(parts)})
SELECT B::INTEGER AS batch_size, dims::INTEGER AS dims, k::INTEGER AS k, codec, direction,
       count(*)::BIGINT AS messages, sum(bytes)::BIGINT AS bytes
FROM sz GROUP BY ALL
"""


@register("codec_grid", _grid_sql())
def codec_grid(spark, sf_dir):
    """Bytes of every codec, both directions, over a grid of batch size x interface dims x k,
    in one job: rows are numbered once, replicated per (batch size, dims) setting by an explode
    of a literal array (the grid is bounded, 6 settings), and one shuffle builds every batch.
    A width below the embeddings' own is their first values, which stand in for a smaller
    interface: no model of that width has made them."""
    emb = read_table(spark, sf_dir, "embeddings")
    idx = dense_index(emb.select("vec_id", relu_array("embedding").alias("e")), ["vec_id"], out="idx", total="n")
    grid = F.array(*[F.struct(F.lit(b).alias("B"), F.lit(d).alias("dims")) for b in GRID_BATCHES for d in GRID_DIMS])
    g = idx.select("idx", "n", "e", F.explode(grid).alias("g")).select(
        "idx", "n", "e", F.col("g.B").alias("B"), F.col("g.dims").alias("dims_cfg"))
    b = F.col("B").cast("long")
    rows = g.select(
        F.col("B").alias("batch_size"), F.col("dims_cfg").alias("grid_dims"),
        F.floor(F.col("idx") / b).cast("long").alias("batch_id"),
        (F.col("idx") % b).cast("int").alias("row_in_batch"),
        F.least(b, F.col("n") - F.floor(F.col("idx") / b) * b).cast("int").alias("batch_rows"),
        F.slice("e", 1, F.col("dims_cfg")).alias("e"))
    counts = codec.run_counts(codec.batch_matrix(rows, "e", keys=("batch_size", "grid_dims", "batch_id")))
    sized = None
    for k in GRID_KS:
        s = codec.codec_sizes(counts, k=k).withColumn("k", F.lit(k))
        sized = s if sized is None else sized.unionByName(s)
    return sized.groupBy("batch_size", F.col("dims").alias("dims"), "k", "codec", "direction").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("bytes").cast("long").alias("bytes")).select(
        F.col("batch_size").cast("int"), F.col("dims").cast("int"), F.col("k").cast("int"),
        "codec", "direction", "messages", "bytes")


# ---------------------------------------------------------------- payload (A8, practical size)

def _payload_sql() -> str:
    sizes = _sweep_sql()
    headers = ", ".join(f"('{c}', '{d}', {payload.header_bytes(c, d)})" for c in codec.CODECS for d in ("emb", "grad"))
    return f"""
SELECT batch_id, codec, direction, bytes AS body_bytes, (bytes + h)::BIGINT AS payload_bytes, true AS lossless
FROM ({sizes}) JOIN (VALUES {headers}) v(codec, direction, h) USING (codec, direction)
"""


@register("payload_size", _payload_sql())
def payload_size(spark, sf_dir):
    """Bytes of every message as it is stored, for all codecs and both directions, beside the
    formula's; each is unpacked again and compared with what was packed.  The gradient of row i is
    the signed embedding of row (i+1) mod S of its batch."""
    b = embedding_batches(spark, sf_dir)
    b = b.withColumn("gi", ((F.col("row_in_batch") + F.col("batch_rows") - 1) % F.col("batch_rows")).cast("int"))
    m = codec.batch_matrix(b, {"flat": ("e", "row_in_batch"), "gflat": ("raw", "gi")})
    kinds = [(c, d) for c in codec.CODECS for d in ("emb", "grad")]
    for c, d in kinds:
        src, emb = ("flat", None) if d == "emb" else ("gflat", "flat")
        parts = payload.message_columns(c, d)
        m = codec.encode(m.withColumn("_f", F.col(src)), c, d, k=SWEEP_K, flat="_f", emb_flat=emb)
        m = m.withColumn(f"{c}_{d}", F.struct(*parts)).drop(*parts)
    stored = m.select("*", *[payload.payload(c, d, f"{c}_{d}").alias(f"p_{c}_{d}") for c, d in kinds])
    back = stored.select("*", *[payload.unpacked(f"p_{c}_{d}", c, d).alias(f"b_{c}_{d}") for c, d in kinds])

    def row(c, d):
        sent, got, size = F.col(f"{c}_{d}"), F.col(f"b_{c}_{d}"), F.octet_length(f"p_{c}_{d}")
        same = [got["samples"] == F.col("samples"), got["dims"] == F.col("dims")]
        same += [got[p] == sent[p] for p in payload.message_columns(c, d)]
        return F.struct(F.lit(c).alias("codec"), F.lit(d).alias("direction"),
                        (size - payload.header_bytes(c, d)).cast("long").alias("body_bytes"),
                        size.cast("long").alias("payload_bytes"), reduce(lambda x, y: x & y, same).alias("lossless"))

    return back.select("batch_id", F.explode(F.array(*[row(c, d) for c, d in kinds])).alias("r")).select("batch_id", "r.*")
