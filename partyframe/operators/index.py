"""Dense row index, seeded splits and batches.

A dense 0-based index in a total order is the backbone of splitting and
batching.  A global ``row_number() over (order by k)`` would pull every row
into one task, so instead, all in one lazy plan that reads nothing but the
order's columns until the last step:

1. splitters cut the order into ranges: quantiles of a sample of the keys, or,
   where the order is a uniform hash, equal parts of its values; as the order
   is total, a hot value of its first column is cut on the next ones;
2. keys are counted per range (partial aggregation, one row per range);
3. running offsets over that table;
4. rows are exchanged once, by range; ``row_number()`` inside each + offset.

Every range is sorted by its own task, at any size of the input; nothing is
written and nothing runs while the query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyframe.session import cut_lineage

PART = "_pf_part"
SAMPLE_PER_RANGE = 50       # sampled keys behind each splitter


def md5_order_key(seed, *cols) -> Column:
    """Deterministic pseudo-random order: ``md5('<seed>:<c1>:<c2>..')`` as hex text."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def md5_spread(hex_key: str) -> Column:
    """Place of an md5 text among all of them, from 0 to 1: grows with the text and is uniform."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def n_ranges(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def splitters(keys: DataFrame, key: str, ranges: int) -> Column:
    """``ranges - 1`` ascending values of a struct column that cut its rows into even parts.

    A subquery: keys are counted, about :data:`SAMPLE_PER_RANGE` a range are
    picked by their hash, and every so many-th of them in order is a splitter.
    """
    rows = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    unit = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    picked = keys.filter(unit < F.lit(float(SAMPLE_PER_RANGE * ranges)) / rows)
    every = picked.agg(F.array_sort(F.collect_list(key)).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))),
                     lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / ranges).cast("int")))
    return every.select(F.slice(F.filter(at, lambda v: v.isNotNull()), 1, ranges - 1).alias("s")).scalar()


def _with_range(df: DataFrame, key: str, cuts: Column, ranges: int) -> DataFrame:
    """Adds ``PART``: how many of the ascending ``cuts`` are not above the key (binary search, one step a column)."""
    out, step = df.withColumn(PART, F.lit(0)), 1 << max(0, (ranges - 1).bit_length() - 1)
    while step and ranges > 1:
        up = F.col(PART) + step
        out = out.withColumn(PART, F.when((up <= F.size(cuts)) & (F.get(cuts, up - 1) <= F.col(key)), up)
                             .otherwise(F.col(PART)))
        step >>= 1
    return out


def _ranged(df: DataFrame, group_by: list[str], order_by: list, spread: Column | None) -> DataFrame:
    """Rows with the number of their range of (groups, order)."""
    ranges = n_ranges(df)
    if spread is not None:
        return df.withColumn(PART, F.least(F.floor(spread * ranges), F.lit(ranges - 1)).cast("int"))
    columns = [F.col(c) if isinstance(c, str) else c for c in [*group_by, *order_by]]
    keyed = df.withColumn("_pf_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)]))
    cuts = splitters(keyed.select("_pf_key"), "_pf_key", ranges)
    return _with_range(keyed, "_pf_key", cuts, ranges).drop("_pf_key")


def _dealt(df: DataFrame, group_by: list[str], order_by: list) -> DataFrame:
    """Rows in ranges of (groups, order), written once so that all readers see the same partitions."""
    return cut_lineage(df.repartitionByRange(*group_by, *order_by).withColumn(PART, F.spark_partition_id()))


def _offsets(dealt: DataFrame, group_by: list[str], value: Column, name: str, total: str | None = None) -> DataFrame:
    """Per partition (and group): the sum of ``value`` over all earlier partitions.

    One row per partition and group it holds; without groups the window runs
    over as many rows as there are partitions.
    """
    sums = dealt.groupBy(*group_by, PART).agg(F.sum(value).alias(name))
    w = Window.partitionBy(*group_by).orderBy(PART) if group_by else Window.orderBy(PART)
    out = sums.withColumn("_pf_off", F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0)))
    if total:
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumn(total, F.sum(name).over(every).cast("long"))
    return out.drop(name)


def dense_index(df: DataFrame, order_by: list, out: str = "idx", total: str | None = None,
                partition_by: list | None = None, spread: Column | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ascending ``order_by`` order.

    ``order_by`` must be a total order (end it with a unique key).  ``total``
    optionally adds the row count as a column.  ``partition_by`` (column
    names) numbers rows independently per group, e.g. per split.  ``spread``,
    where given, grows with the order and is even from 0 to 1: the ranges are
    then equal parts of it and no keys are sampled.

    Ranges are numbered from the columns of the order alone, so hand in rows
    whose keys are cheap to compute (number before a join, not after it).
    """
    groups = list(partition_by or [])
    ranged = _ranged(df, groups, order_by, spread)
    offsets = _offsets(ranged, groups, F.lit(1), "_pf_cnt", total)
    w = Window.partitionBy(*groups, PART).orderBy(*order_by)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in groups] + [F.col(f"r.{PART}") == F.col(f"o.{PART}")]
    added = ["_pf_off"] + ([total] if total else [])
    rows = ranged.withColumn("_pf_rn", F.row_number().over(w)).alias("r")
    return (rows.join(offsets.alias("o"), on).select("r.*", *[f"o.{c}" for c in added])
            .withColumn(out, (F.col("_pf_off") + F.col("_pf_rn") - 1).cast("long"))
            .drop("_pf_off", "_pf_rn", PART))


def seeded_split(df: DataFrame, uid: str, fractions: tuple[float, ...] = (0.1,),
                 names: tuple[str, ...] = ("tr", "te"), seed: int = 0, out: str = "split",
                 holdout: bool = False) -> DataFrame:
    """Split into parts of exact sizes in a seeded pseudo-random order.

    ``fractions`` are applied one after another like repeated
    ``train_test_split``: first ``ceil(n * f0)`` rows go to the last name, then
    ``ceil(rest * f1)`` to the name before it, ... ; the rest to ``names[0]``.
    With ``holdout=True`` (two fractions, three names) the second cut is taken
    from the held-out part instead: ``ceil(n * f0)`` rows are held out and
    ``ceil(held * f1)`` of them go to the last name, the others to the middle one.
    """
    if len(names) != len(fractions) + 1:
        raise ValueError("need one more name than fractions")
    if holdout and len(fractions) != 2:
        raise ValueError("holdout splits take two fractions")
    ordered = df.withColumn("_pf_h", md5_order_key(seed, uid))
    idx = dense_index(ordered, ["_pf_h", uid], out="_pf_r", total="_pf_n", spread=md5_spread("_pf_h"))
    if holdout:
        n = F.col("_pf_n").cast("double")
        held = F.ceil(n * F.lit(float(fractions[0])))
        last = F.ceil(held * F.lit(float(fractions[1])))
        expr = (F.when(F.col("_pf_r") < n - held, F.lit(names[0]))
                .when(F.col("_pf_r") < n - last, F.lit(names[1])).otherwise(F.lit(names[2])))
        return idx.withColumn(out, expr).drop("_pf_h", "_pf_r", "_pf_n")
    # sizes: n_last = ceil(n*f0); rest shrinks by each cut
    rest = F.col("_pf_n").cast("double")
    cut_sizes = []
    for f in fractions:
        size = F.ceil(rest * F.lit(float(f)))
        cut_sizes.append(size)
        rest = rest - size
    # order: names[0] (the remainder) first, then names[1], ..., names[-1]
    first = rest
    bounds = [first]
    acc = first
    for size in reversed(cut_sizes[1:]):
        acc = acc + size
        bounds.append(acc)
    expr = None
    for name, bound in zip(names[:-1], bounds):
        cond = F.col("_pf_r") < bound
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1]))
    return idx.withColumn(out, expr).drop("_pf_h", "_pf_r", "_pf_n")


def assign_batches(df: DataFrame, order_by: list, batch_size: int,
                   partition_by: list | None = None, spread: Column | None = None) -> DataFrame:
    """Contiguous batches of ``batch_size`` rows in the given order, last one short.

    Adds ``batch_id``, ``row_in_batch`` (i) and ``batch_rows`` (S).
    """
    idx = dense_index(df, order_by, out="_pf_i", total="_pf_n", partition_by=partition_by, spread=spread)
    b = F.lit(int(batch_size))
    batch = F.floor(F.col("_pf_i") / b).cast("long")
    rows = F.least(b.cast("long"), F.col("_pf_n") - batch * b).cast("int")
    return (idx.withColumn("batch_id", batch)
            .withColumn("row_in_batch", (F.col("_pf_i") - batch * b).cast("int"))
            .withColumn("batch_rows", rows)
            .drop("_pf_i", "_pf_n"))


def shuffled_batches(df: DataFrame, uid: str, batch_size: int, seed: int = 0,
                     partition_by: list | None = None) -> DataFrame:
    """W3 for training: one fixed seeded permutation (md5 order), contiguous batches."""
    ordered = df.withColumn("_pf_h", md5_order_key(seed, uid))
    return assign_batches(ordered, ["_pf_h", uid], batch_size, partition_by=partition_by,
                          spread=md5_spread("_pf_h")).drop("_pf_h")


def running_sum(df: DataFrame, order_by: list, value: str, out: str = "below",
                partition_by: list | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order_by`` order (sum over all earlier rows).

    Sums in place of counts; the rows (one per distinct score, say) come out of an aggregate, so they are dealt
    out by range and written once instead of being computed again for every step.
    """
    groups = list(partition_by or [])
    dealt = _dealt(df, groups, order_by)
    offsets = _offsets(dealt, groups, F.col(value), "_pf_tot")
    w = Window.partitionBy(*groups, PART).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(offsets, [*groups, PART])
            .withColumn(out, F.col("_pf_off") + F.coalesce(F.sum(value).over(w), F.lit(0)))
            .drop("_pf_off", PART))
