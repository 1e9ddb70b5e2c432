"""Embedding / gradient codecs and their byte accounting.

Layout.  A *batch matrix* row holds one (party, batch): ``samples`` (S),
``dims`` (D) and the S x D values flattened either column-major
(``pos = d*S + i``, the reference default) or row-major (``pos = i*D + d``).
It is built by one shuffle on the batch key (``collect_list`` of at most
``batch_size`` rows - bounded by construction, never by the data size); every
codec after that is a row-local array expression, so a message costs no
further shuffle.

Runs (W4): a *head* is a non-zero position whose predecessor is zero (or the
start); a *tail* is a zero position whose predecessor is non-zero.  A run that
ends at the last cell is open and has no tail, so T is H or H - 1.
NaN counts as non-zero (``NaN <> 0``); nulls must be filled before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.functions.numeric import bits_to_bytes, ceil_log2, fp16_round

def _empty_int_array():
    return F.array().cast("array<int>")

# fixed values: the codec names of the reference (embedding and gradient direction)
CODECS = ("org", "int", "q16", "q8", "q4", "svfl", "svfl16", "topk", "topk16")


# --------------------------------------------------------------------------- layout

def batch_matrix(df: DataFrame, vec_col: str | dict, keys=("batch_id",), i_col: str = "row_in_batch",
                 s_col: str = "batch_rows", axis: int = 1, out: str = "flat") -> DataFrame:
    """Group batch rows into one row per batch with the flattened matrix.

    ``axis=1`` column-major (reference default), ``axis=0`` row-major.
    ``vec_col`` may be a dict ``{out_name: (vec_col, i_col)}`` to flatten several
    matrices of the same batch in one shuffle (e.g. an embedding and the
    gradient that answers it).  Output: keys, samples, dims, flat column(s).
    """
    specs = vec_col if isinstance(vec_col, dict) else {out: (vec_col, i_col)}
    aggs = [F.array_sort(F.collect_list(F.struct(F.col(ic).alias("i"), F.col(vc).alias("v"))))
            .alias(f"_pf_rows_{name}") for name, (vc, ic) in specs.items()]
    g = df.groupBy(*keys).agg(*aggs, F.max(s_col).cast("int").alias("samples"))
    first = next(iter(specs))
    g = g.withColumn("dims", F.size(F.element_at(f"_pf_rows_{first}", 1)["v"]).cast("int"))
    for name in specs:
        g = g.withColumn(name, flatten_rows(f"_pf_rows_{name}", "dims", axis)).drop(f"_pf_rows_{name}")
    return g


def flatten_rows(rows_col: str, dims_col: str, axis: int) -> Column:
    rows = F.col(rows_col)
    if axis == 0:
        return F.flatten(F.transform(rows, lambda r: r["v"]))
    return F.flatten(F.transform(
        F.sequence(F.lit(0), F.col(dims_col) - 1),
        lambda d: F.transform(rows, lambda r: F.get(r["v"], d))))


def position(i, d, samples, dims, axis: int = 1) -> Column:
    """Flat position of cell (i, d)."""
    return (d * samples + i) if axis == 1 else (i * dims + d)


# --------------------------------------------------------------------------- runs

def _nz(flat: Column, p) -> Column:
    return F.coalesce(F.get(flat, p) != 0, F.lit(False))


def run_heads(flat: Column) -> Column:
    n = F.size(flat)
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                    lambda p: (p < n) & _nz(flat, p) & ((p == 0) | ~_nz(flat, p - 1)))


def run_tails(flat: Column) -> Column:
    n = F.size(flat)
    return F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1),
                                  lambda p: ~_nz(flat, p) & _nz(flat, p - 1))).otherwise(_empty_int_array())


def nonzero_values(flat: Column) -> Column:
    return F.filter(flat, lambda v: v != 0)


def rle_encode(mat: DataFrame, flat: str = "flat", half: bool = False) -> DataFrame:
    """Run-length sparse message (vals, head, tail).

    ``half`` rounds the kept values to the fp16 grid; the mask is taken before
    rounding, so a value that underflows is kept as a stored zero (as the
    reference does).
    """
    f = F.col(flat)
    vals = nonzero_values(f)
    if half:
        vals = F.transform(vals, lambda v: fp16_round(v).cast("float"))
    return (mat.withColumn("vals", vals.cast("array<float>"))
            .withColumn("head", run_heads(f))
            .withColumn("tail", run_tails(f))
            .drop(flat))


def run_counts(mat: DataFrame, flat: str = "flat") -> DataFrame:
    """nnz, H, T per batch without materialising the message."""
    f = F.col(flat)
    return (mat.withColumn("nnz", F.size(nonzero_values(f)).cast("long"))
            .withColumn("heads", F.size(run_heads(f)).cast("long"))
            .withColumn("tails", F.size(run_tails(f)).cast("long"))
            .drop(flat))


# --------------------------------------------------------------------------- decoders

def _spans(lo: Column, hi: Column) -> Column:
    """All positions of the intervals [lo, hi), in order."""
    return F.flatten(F.transform(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda r: F.when(
        r["lo"] < r["hi"], F.sequence(r["lo"], r["hi"] - 1)).otherwise(_empty_int_array())))


def _placed(at: Column, values: Column, rest: Column) -> Column:
    """A flat batch from values and their positions; ``rest`` are the positions of its zeros.

    Positions are distinct, so one sort by position puts every cell in its place.
    """
    cells = F.transform(F.arrays_zip(at.alias("p"), values.cast("array<float>").alias("v")),
                        lambda c: F.struct(c["p"].cast("int").alias("p"), c["v"].alias("v")))
    zeros = F.transform(rest, lambda p: F.struct(p.cast("int").alias("p"), F.lit(0.0).cast("float").alias("v")))
    return F.transform(F.sort_array(F.concat(cells, zeros)), lambda c: c["v"])


def rle_flat() -> Column:
    """The flat batch of a run-length message (columns samples, dims, vals, head, tail).

    W5: each head opens an interval that the tail of the same rank closes (an
    open last run ends with the batch); the values fill the intervals in
    order, and the intervals between them are zeros.
    """
    n = F.col("samples") * F.col("dims")
    ends = F.when(F.size("tail") < F.size("head"), F.concat("tail", F.array(n))).otherwise(F.col("tail"))
    gaps = _spans(F.concat(F.array(F.lit(0)), ends), F.concat("head", F.array(n)))
    return _placed(_spans(F.col("head"), ends), F.col("vals"), gaps)


def topk_flat() -> Column:
    """The flat row-major batch of a top-k message (columns samples, dims, idx, val)."""
    every = F.sequence(F.lit(0), F.col("samples") * F.col("dims") - 1)
    return _placed(F.col("idx"), F.col("val"), F.array_except(every, F.col("idx").cast("array<int>")))


def cut_rows(msgs: DataFrame, keys: list[str], flat: str, axis: int, out: str = "decoded") -> DataFrame:
    """A flat batch (a column of ``msgs``) cut back into rows ``(keys, row_in_batch, out ARRAY<FLOAT>)``."""
    s, d = F.col("samples"), F.col("dims")
    rows = F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.struct(
        i.alias("row_in_batch"),
        F.transform(F.sequence(F.lit(0), d - 1), lambda j: F.get(F.col(flat), position(i, j, s, d, axis)).cast("float"))
        .alias(out)))
    return msgs.select(*keys, F.explode(rows).alias("_pf_r")).select(*keys, "_pf_r.row_in_batch", f"_pf_r.{out}")


def decode_to_rows(msgs: DataFrame, keys: list[str], kind: str = "rle", axis: int = 1,
                   out: str = "decoded") -> DataFrame:
    """Decode messages back to rows ``(keys, row_in_batch, out ARRAY<FLOAT>)``.

    Array expressions alone, one message at a time; messages are bounded by
    the batch size.  Top-k positions are row-major whatever ``axis`` is.
    """
    flat, axis = (rle_flat(), axis) if kind == "rle" else (topk_flat(), 0)
    return cut_rows(msgs.withColumn("_pf_flat", flat), keys, "_pf_flat", axis, out)


# --------------------------------------------------------------------------- quantisers

def fp16_flat(flat: Column) -> Column:
    return F.transform(flat, lambda v: fp16_round(v))


def q_embed_encode(mat: DataFrame, levels: int, flat: str = "flat") -> DataFrame:
    """C6 / C8 (embedding): ``scale = max``; code = trunc(v / scale * L), clamped to [0, levels-1]
    for 4-bit (L=16) and [0, 255] for 8-bit (L=255).  scale <= 0 gives codes 0."""
    mult = 255.0 if levels == 256 else float(levels)
    top = levels - 1
    f = F.col(flat)
    scale = F.array_max(f).cast("double")
    m = mat.withColumn("scale", scale)
    codes = F.transform(f, lambda v: F.when(F.col("scale") > 0, F.least(F.greatest(
        F.floor(v.cast("double") / F.col("scale") * mult), F.lit(0)), F.lit(top))).otherwise(F.lit(0))
        .cast("short"))
    negatives = F.size(F.filter(f, lambda v: v < 0)).cast("long")
    return m.withColumn("codes", codes).withColumn("clamped_negatives", negatives).drop(flat)


def q_embed_decode(msgs: DataFrame, levels: int) -> DataFrame:
    mult = 255.0 if levels == 256 else float(levels)
    return msgs.withColumn("decoded", F.transform("codes", lambda c: c.cast("double") * F.col("scale") / mult))


def q_grad_encode(mat: DataFrame, levels: int, flat: str = "flat") -> DataFrame:
    """C7 / C8 (gradient): affine ``(g - lo) / (hi - lo) * L``, truncated; hi = lo gives codes 0."""
    mult = 255.0 if levels == 256 else float(levels)
    top = levels - 1
    f = F.col(flat)
    m = (mat.withColumn("lo", F.array_min(f).cast("double"))
         .withColumn("hi", F.array_max(f).cast("double")))
    span = F.col("hi") - F.col("lo")
    codes = F.transform(f, lambda v: F.when(span > 0, F.least(F.greatest(
        F.floor((v.cast("double") - F.col("lo")) / span * mult), F.lit(0)), F.lit(top)))
        .otherwise(F.lit(0)).cast("short"))
    return m.withColumn("codes", codes).drop(flat)


def q_grad_decode(msgs: DataFrame, levels: int) -> DataFrame:
    mult = 255.0 if levels == 256 else float(levels)
    span = F.col("hi") - F.col("lo")
    return msgs.withColumn("decoded", F.transform(
        "codes", lambda c: c.cast("double") * span / mult + F.col("lo")))


# --------------------------------------------------------------------------- top-k

def topk_encode(mat: DataFrame, k: int, flat: str = "flat", half: bool = False) -> DataFrame:
    """Keep the k largest |v| of a row-major batch (ties: larger position first).

    Sorting a struct (|v|, pos, v) descending gives exactly that order; k >= cells keeps all.
    """
    f = F.col(flat)
    tagged = F.transform(f, lambda v, p: F.struct(F.abs(v.cast("double")).alias("a"),
                                                   p.alias("p"), v.alias("v")))
    top = F.slice(F.sort_array(tagged, asc=False), 1, int(k))
    val = F.transform("_pf_top", lambda s: s["v"])
    if half:
        val = F.transform(val, lambda v: fp16_round(v))
    return (mat.withColumn("_pf_top", top)
            .withColumn("idx", F.transform("_pf_top", lambda s: s["p"]))
            .withColumn("val", val.cast("array<float>"))
            .drop("_pf_top", flat))


# --------------------------------------------------------------------------- masks

def masked_values(grad_flat: Column, emb_flat: Column) -> Column:
    """Gradient values at the non-zero positions of the embedding (same layout)."""
    return F.transform(F.filter(F.arrays_zip(grad_flat.alias("g"), emb_flat.alias("e")),
                                lambda z: z["e"] != 0), lambda z: z["g"])


# --------------------------------------------------------------------------- sizes

def message_bits(codec: str, direction: str, samples, dims, nnz=None, heads=None, tails=None,
                 k: int | None = None) -> Column:
    """Theoretical message size in bits (before ``ceil(/8)``), per the reference formulas.

    ``direction`` is ``emb`` or ``grad``; for sparse gradients ``nnz`` is the
    non-zero count of the *embedding* (positions come from it).
    """
    s = F.col(samples) if isinstance(samples, str) else samples
    d = F.col(dims) if isinstance(dims, str) else dims
    cells = s.cast("long") * d.cast("long")
    q0, q1, q2 = ceil_log2(s), ceil_log2(d), ceil_log2(cells)
    dense = {"org": 32, "int": 32, "q16": 16, "q8": 8, "q4": 4}
    if codec in dense:
        return cells * dense[codec]
    c = lambda x: F.col(x) if isinstance(x, str) else x
    width = 16 if codec.endswith("16") else 32
    if direction == "emb":
        return c(nnz) * width + (c(heads) + c(tails)) * q2 + q0 + q1
    if codec.startswith("svfl"):
        return c(nnz) * width + q0 + q1
    if codec.startswith("topk"):
        keep = F.least(F.lit(int(k)).cast("long"), cells)
        return keep * q2 + keep * width + q0 + q1
    raise ValueError(f"unknown codec {codec}")


def message_bytes(*args, **kw) -> Column:
    return bits_to_bytes(message_bits(*args, **kw))


def codec_sizes(counts: DataFrame, codecs=CODECS, directions=("emb", "grad"), k: int = 1024) -> DataFrame:
    """One row per (batch, codec, direction) from run counts.

    The codec list is a literal array exploded per batch row - no join with a grid table.
    """
    entries = []
    for codec in codecs:
        for direction in directions:
            entries.append(F.struct(F.lit(codec).alias("codec"), F.lit(direction).alias("direction"),
                                    message_bytes(codec, direction, "samples", "dims", "nnz", "heads",
                                                  "tails", k=k).alias("bytes")))
    return (counts.withColumn("_pf_c", F.explode(F.array(*entries)))
            .select(*[c for c in counts.columns], "_pf_c.codec", "_pf_c.direction", "_pf_c.bytes"))


# --------------------------------------------------------------------------- sparsity

def sparsity(df: DataFrame, vec_col: str, eps_grid=(0.0,), by=()) -> DataFrame:
    """Share of cells with ``|v| <= eps`` per group, one pass for the whole eps grid."""
    aggs = []
    for j, eps in enumerate(eps_grid):
        aggs.append(F.sum(F.size(F.filter(vec_col, lambda v: F.abs(v) <= F.lit(float(eps))))).alias(f"_s{j}"))
    aggs.append(F.sum(F.size(vec_col)).alias("_cells"))
    g = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(eps)).alias("eps"), F.col(f"_s{j}").alias("sparse_cells"))
                     for j, eps in enumerate(eps_grid)])
    return (g.withColumn("_pf_e", F.explode(rows))
            .select(*by, "_pf_e.eps", F.col("_pf_e.sparse_cells").cast("long").alias("sparse_cells"),
                    F.col("_cells").cast("long").alias("cells"))
            .withColumn("sparsity", F.col("sparse_cells") / F.col("cells")))


# --------------------------------------------------------------------------- dispatch

DENSE_WIDTH = {"org": 32, "int": 32, "q16": 16, "q8": 8, "q4": 4}


def encode(mat: DataFrame, codec: str, direction: str = "emb", k: int = 1024, flat: str = "flat",
           emb_flat: str | None = None, axis: int = 1) -> DataFrame:
    """Encode a batch matrix with the named codec.

    Embeddings: org / int pass through, q16 rounds to fp16, q8 / q4 quantise
    with the batch maximum, and svfl / topk (fp32) or svfl16 / topk16 (fp16)
    send run-length messages.  ``axis`` is the layout of ``flat`` (1: column-major).
    Gradients: top-k keeps k cells (row-major positions in either layout), svfl sends
    only the values at the embedding's non-zero positions (``emb_flat``),
    q8 / q4 quantise between the batch minimum and maximum.
    """
    f = F.col(flat)
    if codec in ("org", "int"):
        return mat.withColumn("vals", f.cast("array<float>")).drop(flat)
    if codec == "q16":
        return mat.withColumn("vals", fp16_flat(f).cast("array<float>")).drop(flat)
    if codec in ("q8", "q4"):
        levels = 256 if codec == "q8" else 16
        return q_embed_encode(mat, levels, flat) if direction == "emb" else q_grad_encode(mat, levels, flat)
    half = codec.endswith("16")
    if direction == "emb":
        return rle_encode(mat, flat, half=half)
    if codec.startswith("topk"):
        return topk_encode(mat.withColumn(flat, _row_major(f)) if axis == 1 else mat, k, flat, half=half)
    if emb_flat is None:
        raise ValueError("svfl gradients need the embedding's flat matrix (emb_flat) for their mask")
    vals = masked_values(f, F.col(emb_flat))
    if half:
        vals = F.transform(vals, lambda v: fp16_round(v))
    return mat.withColumn("vals", vals.cast("array<float>")).drop(flat)


def _row_major(flat: Column) -> Column:
    """A column-major batch, row by row: cells sorted by their row-major position.

    ``flat`` is an argument and not read inside the lambda, where the
    optimizer would put the expression behind it and evaluate it once a cell.
    """
    s, d = F.col("samples"), F.col("dims")
    cells = F.transform(flat, lambda v, p: F.struct(((p % s) * d + F.floor(p / s).cast("int")).alias("p"), v.alias("v")))
    return F.transform(F.sort_array(cells), lambda c: c["v"])


def decode(msgs: DataFrame, codec: str, keys: list[str], direction: str = "emb", axis: int = 1,
           positions: DataFrame | None = None) -> DataFrame:
    """Decode messages of one codec back to rows ``(keys, row_in_batch, decoded ARRAY<FLOAT>)``.

    Array expressions for every codec, cut back into rows (one message = one
    bounded batch).  A svfl gradient carries values only: ``positions`` holds the head and tail of the
    embedding messages (same keys), which the receiver has kept.
    """
    if codec.startswith("svfl") and direction == "grad":
        if positions is None:
            raise ValueError("svfl gradients are placed by the embedding's kept positions (head, tail)")
        msgs = msgs.join(positions.select(*keys, "head", "tail"), keys)
    if codec in DENSE_WIDTH:
        if codec in ("q8", "q4"):
            levels = 256 if codec == "q8" else 16
            m = q_embed_decode(msgs, levels) if direction == "emb" else q_grad_decode(msgs, levels)
        else:
            m = msgs.withColumn("decoded", F.col("vals"))
        return cut_rows(m, keys, "decoded", axis)
    kind = "topk" if (codec.startswith("topk") and direction == "grad") else "rle"
    return decode_to_rows(msgs, keys, kind=kind, axis=axis)
