"""Near-duplicate vectors: an exact metric range join over cells around pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, merge

CHUNK = 4096
_SLACK = 1e-9               # rounding in distances; it only widens the replication


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", cell_rows: int = 1024, max_pivots: int = 2048) -> DataFrame:
    """Link all pairs of one label whose cosine is at least ``least``, and the groups they form.

    Equal vectors of a label are one class, so copies never meet in pairs.  On
    unit vectors cosine >= least is distance <= r, a metric ball.  Each label
    gets pivots (vectors with the smallest hashes, about one in ``cell_rows``,
    ``max_pivots`` in all); a vector's home is the cell of its nearest pivot,
    and by the triangle inequality its partners' homes are cells whose pivot is
    at most 2r farther: it is copied into those.  Every cell finds the links of
    its home vectors on its own.  A cell of more than ``CHUNK`` vectors is
    cut into chunks, and each pair of chunks is a task of its own.

    Returns id_col, n_links (other vectors linked directly), component_id
    (smallest id reachable by links), kept: one row per input row.  Rows with
    a null id or label, and vectors that are null, empty, zero, or hold null
    or non-finite components, link with nothing; neither do vectors of unequal
    length.  Rows that share an id count on their own.  Extra columns are
    ignored.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vec, lambda x: x != 0)
    valid = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & ~bad & ~zero
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("vec"),
                          F.coalesce(valid, F.lit(False)).alias("valid"))
    classes = C.checkpointed(rows.filter("valid").groupBy("label", "vec")
                             .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
                             .withColumn("rep", F.xxhash64("label", "vec"))
                             .withColumn("kind", F.xxhash64("label", F.size("vec"))))

    # pivots: a few per kind (label and length), bounded in all
    sizes = classes.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    wanted = sizes.select("kind", F.col("size"), F.floor(F.col("size") / cell_rows).alias("k")).filter("k >= 2")
    total = wanted.agg(F.sum("k")).first()[0] or 0
    share = min(1.0, max_pivots / total) if total else 0.0
    unit = (F.xxhash64("vec", F.lit(7)).cast("double") / F.lit(2.0 ** 64)) + 0.5      # even over [0, 1)
    pivots: dict[int, np.ndarray] = {}
    if total:
        picked = (classes.join(wanted, "kind").filter(unit < F.col("k") / F.col("size") * share)
                  .select("kind", "vec").toArrow())                  # about max_pivots vectors at most
        for kind in pc.unique(picked.column("kind")).to_pylist():
            mine = picked.filter(pc.equal(picked.column("kind"), kind)).column("vec")
            pivots[kind] = _units(mine)
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            kinds = t.column("kind").to_numpy()
            for kind in np.unique(kinds):
                at = np.flatnonzero(kinds == kind)
                some = t.take(pa.array(at))
                if kind in sent.value:
                    d = np.sqrt(np.maximum(2 - 2 * (_units(some.column("vec")) @ sent.value[kind].T), 0))
                    home = d.argmin(axis=1)
                    row, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * radius + _SLACK)
                    here = home[row] == cell
                else:
                    row, cell, here = np.arange(len(at)), np.zeros(len(at), int), np.ones(len(at), bool)
                got = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [got.column("kind").combine_chunks(), pa.array(cell.astype(np.int32)), pa.array(here),
                     got.column("rep").combine_chunks(), got.column("n").combine_chunks(),
                     got.column("vec").combine_chunks()], names=["kind", "cell", "home", "rep", "n", "vec"])

    element = classes.schema["vec"].dataType.simpleString()
    dealt = classes.select("kind", "rep", "n", "vec").mapInArrow(
        deal, f"kind long, cell int, home boolean, rep long, n long, vec {element}")
    members = dealt.groupBy("kind", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep", "vec"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    dealt = dealt.join(members, ["kind", "cell"]).withColumn("own", own)
    # to every chunk as a member, and, at home, to the other chunks of its own row of the grid
    asked = F.transform(every, lambda a: F.struct(a.alias("a"), F.col("own").alias("b"),
                                                  (F.col("home") & (a == F.col("own"))).alias("ask"),
                                                  F.lit(True).alias("member")))
    asks = F.transform(F.filter(every, lambda b: F.col("home") & (b != F.col("own"))),
                       lambda b: F.struct(F.col("own").alias("a"), b.alias("b"), F.lit(True).alias("ask"),
                                          F.lit(False).alias("member")))
    grid = dealt.select("kind", "cell", "rep", "n", "vec", F.explode(F.concat(asked, asks)).alias("g")).select(
        "kind", "cell", "g.a", "g.b", "g.ask", "g.member", "rep", "n", "vec")

    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ask = np.flatnonzero(t.column("ask").to_numpy(zero_copy_only=False))
        member = np.flatnonzero(t.column("member").to_numpy(zero_copy_only=False))
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        if not len(ask) or not len(member):
            return out.empty_table()
        unit = _units(t.column("vec"))
        raw = _matrix(t.column("vec"))
        norm = np.sqrt((raw * raw).sum(axis=1))
        labels = np.arange(len(rep))
        links = np.zeros(len(rep), np.int64)
        for lo in range(0, len(ask), 512):
            some = ask[lo:lo + 512]
            close = unit[some] @ unit[member].T >= least - 1e-12
            i, j = np.nonzero(close)
            i, j = some[i], member[j]
            other = i != j
            i, j = i[other], j[other]
            edge = np.abs(np.einsum("ij,ij->i", unit[i], unit[j]) - least) <= 1e-9 if len(i) else np.zeros(0, bool)
            if edge.any():                      # at the threshold: the plain formula decides
                e = np.flatnonzero(edge)
                exact = np.einsum("ij,ij->i", raw[i[e]], raw[j[e]]) / (norm[i[e]] * norm[j[e]])
                keep = np.ones(len(i), bool)
                keep[e[exact < least]] = False
                i, j = i[keep], j[keep]
            links += np.bincount(i, weights=n[j], minlength=len(rep)).astype(np.int64)
            labels = merge(labels, i, j)
        some = np.flatnonzero((links > 0) | (labels != np.arange(len(rep))))
        return pa.table([rep[some], links[some], rep[labels[some]]], schema=out)

    # each pair of cells and chunks is read once by its home side; roots are classes met in the task
    found = C.checkpointed(grid.groupBy("kind", "cell", "a", "b").applyInArrow(join, "rep long, links long, root long"))
    per_rep = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    groups = groups.join(classes.select("rep", "low"), "rep")
    lowest = groups.groupBy("component").agg(F.min("low").alias("lowest"))
    groups = groups.join(lowest, "component").select("rep", "lowest")
    known = C.checkpointed(classes.select("label", "vec", "rep", "low", "n").join(per_rep, "rep", "left")
                           .join(groups, "rep", "left")
                           .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                                   F.coalesce("lowest", "low").alias("component")))
    joined = rows.filter("valid").join(known, ["label", "vec"]).select("id", "links", "component")
    alone = rows.filter("not valid").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    return arr.flatten().to_numpy().astype(float).reshape(len(arr), -1)


def _units(column) -> np.ndarray:
    raw = _matrix(column)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
