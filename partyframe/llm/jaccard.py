"""Near-duplicate texts: a set-similarity join on word shingles by chosen paths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, merge

POSITIONS = 64              # minhash positions of a set; a path samples some of them
SMALL = 4096                # a bucket of more sets is split on further positions
CHUNK = 1024                # sets per side of one verification task
START_DEPTH, LAST_DEPTH = 2, 4
U = np.uint64
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- sets

def shingles(words: C.Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), sorted and distinct; a row of 1 to k - 1 words has one shingle, all its words."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = words.hashes()
    ok = C.windows_in_row(words.row, k)
    row, value = words.row[:len(ok)][ok], C.window_hash(h, k)[ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        first = words.first[short]
        total = np.zeros(len(short), U)
        for j in range(k - 1):
            more = words.counts[short] > j
            total[more] = total[more] * U(0x9E3779B97F4A7C15) + h[first[more] + j] + U(j + 1)
        row, value = np.concatenate([row, short]), np.concatenate([value, C.mix(total)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """16 bits of the minhash at each position, per row that has shingles (zeros for the others)."""
    out = np.zeros((rows, POSITIONS), np.uint16)
    if not len(row):
        return out
    some, first = np.unique(row, return_index=True)
    for i in range(POSITIONS):
        odd, salt = U((2 * i + 1) * 0x9E3779B97F4A7C15 & _MASK), U((i + 1) * 0xA0761D6478BD642F & _MASK)
        low = np.minimum.reduceat((value ^ salt) * odd, first)
        out[some, i] = (C.mix(low) & U(0xFFFF)).astype(np.uint16)
    return out


def children(path: np.ndarray, sig: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(parent index, child path): a node samples each position with chance 1 / (least * POSITIONS).

    The choice depends on the path alone, so two sets on one path agree on the
    positions and part only where their minhashes differ.
    """
    limit = U(int(2 ** 64 / (least * POSITIONS)))
    at, where, out = [], [], []
    for i in range(POSITIONS):
        picked = np.flatnonzero(C.mix(path + U((i + 1) * 0xD6E8FEB86659FD93 & _MASK)) < limit)
        at.append(picked)
        out.append(C.mix(path[picked] * U(0x9E3779B97F4A7C15) + (U(i + 1) << U(16)) + sig[picked, i].astype(U)))
    return np.concatenate(at), np.concatenate(out)


def survival(depth: int, mean: float = 1.0) -> float:
    """Chance that two sets at the least similarity still share a path after ``depth`` splits of one run."""
    alive = 1.0
    for _ in range(depth):
        # POSITIONS independent picks with chance mean / POSITIONS, each alive below with chance ``alive``
        alive = 1 - (1 - mean * alive / POSITIONS) ** POSITIONS
    return alive


# ---------------------------------------------------------------- the join

def near_texts(docs: DataFrame, least: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
               recall: float = 0.999, small: int = SMALL) -> DataFrame:
    """Link all texts whose sets of ``k``-word shingles have Jaccard similarity ``least`` or more.

    Words are taken unchanged.  Texts with equal sets are one class (its
    smallest id stands for it), so copies never meet in pairs.

    1. Chosen paths: in each run every set walks down ``START_DEPTH`` splits,
       each on minhash positions that its path samples; sets that end on the
       same path share a bucket.  Buckets of more than ``small`` sets are split
       again, down to ``LAST_DEPTH``.  The number of runs follows from ``recall``,
       the chance that two sets at ``least`` share a bucket at the last depth.
    2. Small buckets are compared by brute force on the signatures (with a
       margin of four deviations below ``least``); what is left too large is
       compared in chunks, pairs of chunks being tasks of their own.
    3. Connected candidates are gathered once, with their whole sets, and all
       pairs among them are verified exactly, again in pairs of chunks.

    Returns id_col, class_id (smallest id of the group of linked texts),
    n_links (other rows linked directly, copies counted), kept, text_hash
    (xxhash64 of the text): one row per input row.  Null and empty texts, texts without words, and rows with a
    null id link with nothing.  Rows that share an id count on their own.
    Extra columns are ignored.
    """
    runs = math.ceil(math.log(1 - recall) / math.log(1 - survival(LAST_DEPTH)))
    margin = least - 4 * math.sqrt(least * (1 - least) / POSITIONS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.col(text_col)).alias("text_hash"))
    sized = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int32()),
                       ("sig", pa.binary(2 * POSITIONS))])

    def digest(batches):
        for batch in batches:
            for t in C.slices(batch, max_bytes=2 << 20):
                words = C.Words(t.column("text"))
                row, value = shingles(words, k)
                size = np.bincount(row, minlength=words.rows)
                k1, k2 = np.zeros(words.rows, U), np.zeros(words.rows, U)
                some = np.flatnonzero(size)
                if len(some):
                    first = np.searchsorted(row, some)
                    k1[some] = np.add.reduceat(value, first)
                    k2[some] = np.add.reduceat(C.mix(value + U(1)), first)
                sig = signatures(row, value, words.rows)
                yield pa.RecordBatch.from_arrays(
                    [t.column("id").combine_chunks(), t.column("text_hash").combine_chunks(), pa.array(C.signed(k1)), pa.array(C.signed(k2)),
                     pa.array(size.astype(np.int32)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * POSITIONS), words.rows,
                                                          [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())],
                    names=sized.names)

    rows = C.checkpointed(texts.mapInArrow(digest, "id long, text_hash long, k1 long, k2 long, size int, sig binary"))
    linkable = rows.filter("size > 0 and id is not null")
    key = ["k1", "k2", "size"]
    # a class is a node; its number comes from the key, so that rows which share an id stay apart
    classes = C.checkpointed(linkable.groupBy(*key).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"),
                                                        F.min("sig").alias("sig"))
                             .withColumn("rep", F.xxhash64(*key)))

    # 1. paths
    def walk(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                rep, sig = b.column("rep").to_numpy(), _sig(b.column("sig"))
                path = np.repeat(C.mix(np.arange(1, runs + 1, dtype=U)), len(rep))
                who = np.tile(np.arange(len(rep)), runs)
                for _ in range(START_DEPTH):
                    at, path = children(path, sig[who], least)
                    who = who[at]
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(path)), pa.array(rep[who])], names=["path", "rep"])

    reps = classes.select("rep", "sig")
    paths = reps.mapInArrow(walk, "path long, rep long")
    level = _shared(paths).join(reps, "rep")
    edges = None
    for depth in range(START_DEPTH, LAST_DEPTH + 1):
        level = C.checkpointed(level.select("path", "rep", "sig", "size"))
        few = level.filter(F.col("size") <= small).repartition("path").sortWithinPartitions("path", "rep")
        found = few.select("path", "rep", "sig").mapInArrow(lambda it: _compare(it, margin), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        big = level.filter(F.col("size") > small)
        if big.isEmpty():
            break
        if depth == LAST_DEPTH:
            edges = edges.unionByName(_dense(big, margin))
        else:
            def split(batches):
                for batch in batches:
                    sig = _sig(batch.column("sig"))
                    at, path = children(batch.column("path").to_numpy().view(U), sig, least)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(C.signed(path)), batch.column("rep").take(pa.array(at)),
                         batch.column("sig").take(pa.array(at))], names=["path", "rep", "sig"])
            down = big.select("path", "rep", "sig").mapInArrow(split, "path long, rep long, sig binary")
            sizes = down.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
            level = down.join(sizes, "path")

    # 3. candidates meet with their whole sets
    groups = C.checkpointed(components(edges, "a", "b"))
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = (groups.withColumnRenamed("node", "rep").join(sizes, "component").join(classes, "rep")
               .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
               .select(F.col("low").alias("id"), "component", "rep", "n", "chunks", "own", "k1", "k2"))

    def sets(batches):
        for batch in batches:
            for t in C.slices(batch):
                row, value = shingles(C.Words(t.column("text")), k)
                first = np.searchsorted(row, np.arange(t.num_rows + 1)).astype(np.int32)
                some = np.flatnonzero(np.diff(first))
                same = np.zeros(t.num_rows, bool)       # the text of the class, not another row with its id
                if len(some):
                    same[some] = ((np.add.reduceat(value, first[some]) == t.column("k1").to_numpy().view(U)[some])
                                  & (np.add.reduceat(C.mix(value + U(1)), first[some])
                                     == t.column("k2").to_numpy().view(U)[some]))
                made = pa.ListArray.from_arrays(pa.array(first), pa.array(C.signed(value)))
                cols = [t.column(c).combine_chunks() for c in ("component", "rep", "n", "chunks", "own")]
                yield pa.RecordBatch.from_arrays([*cols, made], names=["component", "rep", "n", "chunks", "own",
                                                                       "set"]).filter(pa.array(same))

    whole = (texts.join(members, "id").drop("id", "text_hash")
             .mapInArrow(sets, "component long, rep long, n long, chunks int, own int, set array<long>")
             .dropDuplicates(["component", "rep", "own"]))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    grid = whole.withColumn("other", other).select(
        "component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "n", "set")
    verified = C.checkpointed(grid.groupBy("component", "a", "b").applyInArrow(
        lambda t: _verify(t, least), "rep long, links long, root long"))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(verified.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    linked = linked.join(classes.select("rep", "low"), "rep")
    lowest = linked.groupBy("component").agg(F.min("low").alias("class_id"))
    linked = linked.join(lowest, "component").select("rep", "class_id")
    known = C.checkpointed(classes.select(*key, "rep", "low", "n").join(links, "rep", "left")
                           .join(linked, "rep", "left")
                           .select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                                   F.coalesce("class_id", "low").alias("class_id")))
    # rows that link with nothing stay in the join, spread by id: with a filter on this side Spark takes it for small
    # and adds run-time Bloom filters of the keys, of a megabyte and more each, which the driver builds and sends
    k1 = F.when(F.col("size") > 0, F.col("k1")).otherwise(F.xxhash64("id"))
    joined = (rows.select("id", "text_hash", k1.alias("k1"), "k2", "size").join(known, key, "left")
              .withColumn("links", F.when(F.col("id").isNotNull(), F.col("links")))
              .withColumn("class_id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))))
    return joined.select(
        F.col("id").alias(id_col), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "text_hash")


def _shared(paths: DataFrame) -> DataFrame:
    """Paths of two sets or more, with their number."""
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return paths.join(sizes, "path")


def _sig(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(arr.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _compare(batches, margin: float):
    """Rows sorted by path: similar pairs within a path, as the edges of a forest."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        path = t.column("path").to_numpy()
        if not len(path):
            continue
        stop = int(np.searchsorted(path, path[-1]))         # the last path may go on in the next batch
        held = t.slice(stop)
        if stop:
            yield _forest(t.slice(0, stop), margin)
    if held is not None and held.num_rows:
        yield _forest(held, margin)


def _forest(t: pa.Table, margin: float) -> pa.RecordBatch:
    path, rep = t.column("path").to_numpy(), t.column("rep").to_numpy()
    sig = _sig(t.column("sig"))
    labels = np.arange(len(path))
    need = int(math.ceil(margin * POSITIONS))
    off = 1
    at = np.arange(len(path))
    while True:
        at = at[at + off < len(path)]
        at = at[path[at] == path[at + off]]
        if not len(at):
            break
        apart = at[labels[at] != labels[at + off]]          # a forest needs no second link
        close = apart[(sig[apart] == sig[apart + off]).sum(axis=1) >= need]
        labels = merge(labels, close, close + off)
        off += 1
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    return pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(rep[labels[tied]])], names=["a", "b"])


def _dense(level: DataFrame, margin: float) -> DataFrame:
    """Edges inside buckets that stay large at the last depth: pairs of chunks, each a task of its own."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    grid = (level.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("path", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "sig"))

    def one(t: pa.Table) -> pa.Table:
        rep, sig = t.column("rep").to_numpy(), _sig(t.column("sig"))
        need = int(math.ceil(margin * POSITIONS))
        labels = np.arange(len(rep))
        for i in range(len(rep)):
            close = i + 1 + np.flatnonzero((sig[i + 1:] == sig[i]).sum(axis=1) >= need)
            close = close[labels[close] != labels[i]]
            if len(close):
                labels = merge(labels, np.full(len(close), i), close)
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": rep[tied], "b": rep[labels[tied]]})

    return grid.groupBy("path", "x", "y").applyInArrow(one, "a long, b long")


def _verify(t: pa.Table, least: float) -> pa.Table:
    """Exact similarities within one chunk, or across two: links per set and a forest of the linked."""
    t = t.sort_by([("rep", "ascending")])
    rep, n, own = (t.column(c).to_numpy() for c in ("rep", "n", "own"))
    across = t.column("a")[0].as_py() != t.column("b")[0].as_py()
    sets = t.column("set").combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        sets = pa.concat_arrays(sets.chunks)
    values = sets.flatten().to_numpy()
    size = np.diff(sets.offsets.to_numpy())
    first = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(rep)), size)
    _, token, count = np.unique(values, return_inverse=True, return_counts=True)
    by_token = row[np.argsort(token, kind="stable")]        # rows of each token, in row order
    start = np.concatenate(([0], np.cumsum(count)))
    labels = np.arange(len(rep))
    links = np.zeros(len(rep), np.int64)
    for i in range(len(rep)):
        mine = token[first[i]:first[i + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        length = count[mine]
        place = np.arange(int(length.sum())) + np.repeat(start[mine] - (np.cumsum(length) - length), length)
        common = np.bincount(by_token[place], minlength=len(rep))
        close = common >= least * (size[i] + size - common) - 1e-9
        close[i] = False
        if across:
            close &= own != own[i]
        j = np.flatnonzero(close)
        if len(j):
            links[i] += n[j].sum()
            labels = merge(labels, np.full(len(j), i), j)
    some = np.flatnonzero((links > 0) | (labels != np.arange(len(rep))))
    return pa.table({"rep": rep[some], "links": links[some], "root": rep[labels[some]]})
