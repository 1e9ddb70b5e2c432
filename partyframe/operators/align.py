"""Vertical projection, party alignment and label weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def party_features(df: DataFrame, uid: str, parts: list[Column], out: str = "features") -> DataFrame:
    """One party's columns as one ``ARRAY<DOUBLE>`` (keeps codegen under the field limit).

    ``parts`` are ``ARRAY<DOUBLE>`` expressions (wrap scalars in ``F.array``),
    concatenated in order; Catalyst prunes every other column of ``df``.
    """
    return df.select(F.col(uid).alias("uid"), F.concat(*parts).alias(out))


def zero_fill(col, n: int) -> Column:
    """Missing party row -> n zeros; null or NaN element -> 0."""
    c = F.col(col) if isinstance(col, str) else col
    filled = F.coalesce(c, F.array_repeat(F.lit(0.0), n))
    return F.transform(filled, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def align_parties(parties: list[tuple[DataFrame, int]], uid: str = "uid") -> DataFrame:
    """Left-join every party on ``uid`` starting from party 0; missing rows filled with zeros.

    ``parties`` = [(frame(uid, features), width), ...]; output ``uid, x0 .. xk``.
    Rows absent from party 0 are dropped (the reference's left join).  A uid
    that a party holds twice is an error, raised while the query runs.

    One exchange: all parties' rows, tagged, are grouped by uid once, and a
    group (one row a party) places each party's array.  Null uids are kept
    where party 0 has them and match nothing; each is a group of its own.
    """
    tagged = None
    for p, (frame, _) in enumerate(parties):
        own = frame.select(F.col(uid).alias(uid), F.lit(p).alias("p"),
                           F.col(frame.columns[1]).cast("array<double>").alias("f"))
        if p:
            own = own.filter(F.col(uid).isNotNull())
        own = own.withColumn("none", F.when(F.col(uid).isNull(), F.monotonically_increasing_id()))
        tagged = own if tagged is None else tagged.unionByName(own)
    met = tagged.groupBy(uid, "none").agg(F.collect_list(F.struct("p", "f")).alias("rows"))
    held = [F.filter("rows", _of_party(p)) for p in range(len(parties))]
    met = met.select(uid, *[h.alias(f"r{p}") for p, h in enumerate(held)]).filter(F.size("r0") > 0)

    def place(p: int, width: int) -> Column:
        twice = F.raise_error(F.concat(F.lit(f"party {p}: {uid} occurs twice: "), F.col(uid).cast("string")))
        one = F.when(F.size(f"r{p}") > 1, twice.cast("array<double>")).otherwise(F.get(f"r{p}", F.lit(0))["f"])
        return zero_fill(one, width).alias(f"x{p}")

    return met.select(uid, *[place(p, w) for p, (_, w) in enumerate(parties)])


def _of_party(p: int):
    return lambda r: r["p"] == p


def concat_parties(n_parties: int, out: str = "x") -> Column:
    """Embeddings / features of all parties side by side, in party order."""
    return F.concat(*[F.col(f"x{p}") for p in range(n_parties)]).alias(out)


def pos_weight(labels: DataFrame, y: str = "y") -> DataFrame:
    """A4: ``n_neg / n_pos`` in one aggregation."""
    return labels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).cast("long").alias("n_pos")).withColumn(
        "pos_weight", (F.col("n") - F.col("n_pos")) / F.col("n_pos"))


def class_weight(labels: DataFrame, y: str = "y") -> DataFrame:
    """``n / n_c`` per class, ordered by class.

    Per-class counts are a partial aggregation; the total is a subquery.
    """
    total = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = labels.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    return per.withColumn("weight", total / F.col("n_c")).orderBy(y)


def class_weight_list(labels: DataFrame, n_classes: int, y: str = "y") -> list[float | None]:
    """A5 as a driver list indexed by class (0 .. n_classes - 1): one weight per output of the model.

    A class without rows has no weight (None).
    """
    held = {r[y]: r["weight"] for r in class_weight(labels, y).filter(F.col(y).between(0, n_classes - 1)).collect()}
    return [held.get(c) for c in range(n_classes)]


def with_class_weight(df: DataFrame, labels: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """A5 on rows: the weight of each row's class in ``labels`` by a join, for any number of classes.

    A class that ``labels`` does not hold, and a null class, give null.
    """
    per = class_weight(labels, y).select(F.col(y).alias("_pf_class"), F.col("weight").alias(out))
    return df.join(per, F.col(y) == F.col("_pf_class"), "left").drop("_pf_class")
