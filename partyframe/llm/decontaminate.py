"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact check.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K = 5                       # words per shingle
SLACK = 4                   # shingles beyond the item's length at either end that still count as one place
UNIT = 1 << 32              # weights are whole numbers of 1 / UNIT, so sums are exact in any order
SIZES = (1, 2, 4)           # shingles per window; an item has the largest that keeps the guarantee
RADIUS = 2                  # fingerprints within this distance are found without fail
BLOCKS = ((0, 22), (22, 21), (43, 21))      # RADIUS + 1 runs of bits: such fingerprints agree on one of them
INDEX_ROWS = 500_000        # rows of the windows' index that are broadcast at a time
_SEPARATORS = " \t\n\x0b\f\r"


def _shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds ``h``: 64-bit hashes of each run of ``K`` lower-case words of ``text``, in order."""
    words = F.split(F.btrim(F.lower(F.col(text)), F.lit(_SEPARATORS)), f"[{_SEPARATORS}]+")
    # an explode of one array keeps the optimizer from copying the split into the lambda, once per word
    df = df.select("*", F.explode(F.array(words)).alias("_w"))
    most = F.greatest(F.size("_w") - K + 1, F.lit(0))
    made = F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(K)]))
    return df.withColumn("h", F.slice(made, F.lit(1), most)).drop("_w")


def _fingerprint(m: int) -> Column:
    """SimHash of the window of ``m`` shingles of ``h`` from ``at`` on (null past the end): a bit is set where more
    than half of them have it."""
    a = [F.get("h", F.col("at") + j) for j in range(m)]
    if m == 1:
        return a[0]
    if m == 2:
        return a[0].bitwiseAND(a[1])
    return (a[0].bitwiseAND(a[1]).bitwiseAND(a[2].bitwiseOR(a[3]))).bitwiseOR(
        a[2].bitwiseAND(a[3]).bitwiseAND(a[0].bitwiseOR(a[1])))


def _blocks(m: int) -> list[Column]:
    """One long per block of a fingerprint ``f<m>``: window size, block number, the block's bits."""
    return [F.lit((m * len(BLOCKS) + b) << 22).cast("long").bitwiseOR(
        F.shiftrightunsigned(f"f{m}", at).bitwiseAND(F.lit((1 << n) - 1))) for b, (at, n) in enumerate(BLOCKS)]


def _windows(df: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per shingle of ``h``, with the fingerprint ``f<m>`` of the window of each size that starts there.

    The windows are read from the array row by row, so this compiles to plain loops.
    """
    return df.select("*", F.posexplode("h").alias("at", "x")).select(
        *[c for c in df.columns if c != "h"], *[_fingerprint(m).alias(f"f{m}") for m in sizes])


def leaking_texts(docs: DataFrame, items: DataFrame, least: float = 0.8, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, share) for every distinct text, by the md5 of its bytes; see :func:`find_leaks`."""
    named = _shingles(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")).dropna().distinct(), "t")
    named = C.checkpointed(named.select("item", "h").filter(F.size("h") > 0).distinct()
                           .withColumn("passage", F.xxhash64("item", "h")))
    total = named.count()
    weights = (named.select(F.explode(F.array_distinct("h")).alias("x")).groupBy("x")
               .agg(F.round(F.log1p(F.lit(float(total)) / F.count(F.lit(1))) * UNIT).cast("long").alias("weight")))
    weighted = C.checkpointed(
        named.select("passage", "item", F.size("h").alias("n"), F.explode(F.array_distinct("h")).alias("x"))
        .join(weights, "x").withColumn("whole", F.sum("weight").over(Window.partitionBy("passage"))))

    sized = named.join(_window_sizes(named, weighted, least), "passage").select("passage", "h", "own")
    own = F.when(F.col("own") == 1, F.array(*_blocks(1))).when(F.col("own") == 2, F.array(*_blocks(2))).otherwise(
        F.array(*_blocks(4)))
    index = C.checkpointed(
        _windows(sized, list(SIZES)).select("passage", "own", _of_size("own", SIZES).alias("item_fp"),
                                            F.explode(own).alias("block")).filter("item_fp is not null").distinct())
    used = sorted(r["own"] for r in index.select("own").distinct().collect())
    parts = -(-index.count() // INDEX_ROWS)

    rows = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("t")).filter("t is not null")
    found = [index.select(F.lit("").alias("key"), "passage").limit(0)]
    seen = None
    if used:
        seen = _windows(_shingles(rows, "t").select("key", "h"), used).select(
            "*", F.explode(F.array(*[b for m in used for b in _blocks(m)])).alias("block"))
    for i in range(parts):              # each part of the index is bounded, whatever the number of items
        part = index.filter(F.pmod(F.xxhash64("block", F.lit("part")), F.lit(parts)) == i)
        near = seen.join(F.broadcast(part), "block").filter(
            F.bit_count(_of_size("own", used).bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        found.append(near.select("key", "passage").distinct())
    pairs = C.checkpointed(reduce(DataFrame.unionByName, found).distinct())

    # exact check: a shingle at place p counts for stretches that start after p - length (or after its last place
    # before p, which counts until there) and no later than p; so no shingle counts twice in one stretch
    texts = rows.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    met = _shingles(texts, "t").select("key", F.posexplode("h").alias("at", "x"))
    live = weighted.join(pairs.select("passage").distinct(), "passage", "left_semi")
    places = met.join(pairs, "key").join(live, ["passage", "x"])
    same = Window.partitionBy("key", "passage", "x").orderBy("at")
    start = F.greatest(F.col("at") - F.col("n") - 2 * SLACK, F.lag("at").over(same)) + 1
    steps = places.withColumn("start", start).select("key", "passage", "item", "whole", F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.col("weight").alias("step")),
        F.struct((F.col("at") + 1).alias("at"), (-F.col("weight")).alias("step")))).alias("e"))
    held = F.sum("e.step").over(Window.partitionBy("key", "passage").orderBy("e.at"))
    share = steps.withColumn("held", held).groupBy("key", "passage", "item").agg(
        (F.max("held") / F.first("whole")).alias("share"))
    return C.checkpointed(share.groupBy("key", "item").agg(F.max("share").alias("share"))
                          .filter(F.col("share") >= least - 1e-12))


def _of_size(size: str, sizes: Iterable[int]) -> Column:
    """The fingerprint of the row's window size."""
    return F.coalesce(*[F.when(F.col(size) == m, F.col(f"f{m}")) for m in sizes])


def _window_sizes(named: DataFrame, weighted: DataFrame, least: float) -> DataFrame:
    """(passage, own): the largest window size at which no 1 - ``least`` of an item's weight touches all windows.

    Windows that don't overlap are counted.  To touch one costs at least the
    weight of its lightest shingle, and nothing where a shingle stands twice
    in the item, as the other place may remain; so if the lightest weights add
    up to more than may be gone, one window is whole.
    """
    places = named.select("passage", F.posexplode("h").alias("at", "x"))
    many = places.groupBy("passage", "x").agg(F.count(F.lit(1)).alias("times"))
    part = (places.join(many, ["passage", "x"]).join(weighted.select("passage", "x", "weight", "whole"), ["passage", "x"])
            .withColumn("part", F.when(F.col("times") == 1, F.col("weight")).otherwise(0)))
    tiles = part.select("passage", "whole", "part", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.floor(F.col("at") / m).alias("tile")) for m in SIZES])).alias("t"))
    lightest = (tiles.groupBy("passage", "t.m", "t.tile").agg(
        F.min("part").alias("low"), F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole"))
        .filter(F.col("n") == F.col("m")))
    kept = lightest.groupBy("passage", "m").agg(F.sum("low").alias("low"), F.first("whole").alias("whole"))
    safe = kept.filter((F.col("m") == 1) | (F.col("low") > F.col("whole") * (1 - least + 1e-9)))
    return safe.groupBy("passage").agg(F.max("m").alias("own"))


def text_key(text_col: str) -> Column:
    return F.md5(F.col(text_col).cast("binary"))


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a passage of an item: shares at least ``least`` of its weighted shingles in one place.

    Shingles are ``K`` lower-case words; a shingle weighs log(1 + items /
    items with it).  A place is a stretch of the item's length with ``SLACK``
    more shingles at either end, wherever it starts; each of the item's
    shingles counts once in it.

    Windows of 1, 2 or 4 shingles run over items and texts; their SimHash
    fingerprints are matched on blocks of bits, so that all pairs within
    ``RADIUS`` bits agree on one, and every text with such a window is
    compared exactly, over all stretches.  The guarantee: an item's windows
    are so short (see :func:`_window_sizes`) that a copy which has lost words,
    or had words put in or replaced, but holds ``least`` of the weight, keeps
    one of them unchanged.  Item windows are broadcast in parts of at most
    ``INDEX_ROWS`` rows, one pass over the documents each.  Items of fewer
    than ``K`` words and null texts match nothing.

    Returns id_col, item_col, similarity: one row per input row and item
    (repeated input rows repeat).  Rows with a null id are kept as null.  Extra
    columns are ignored.
    """
    leaks = leaking_texts(docs, items, least, text_col, item_col, item_text)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    return rows.join(leaks, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col),
                                          F.col("share").alias("similarity"))
