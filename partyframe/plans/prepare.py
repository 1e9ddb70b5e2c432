"""Entry 1 of the reference as one call: raw table -> encoded party datasets.

``prepare_vertical`` fits the encoders (one job), encodes, numbers the rows
in a given order (W1), splits them with exact sizes (W2), cuts the encoded
features into the parties' column groups (P14) and, if asked, writes one
Parquet dataset per party plus the labels (S5).  The label is the one-hot
column of the second category in sorted order (P7), as the census
preparation does, or any Column the caller gives.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.functions.numeric import round6
from partyframe.operators import prep
from partyframe.operators.index import dense_index, seeded_split
from partyframe.plans.registry import register
from partyframe.sources import io
from partyframe.sources.tables import read_table


@dataclass
class PrepSpec:
    numeric: list[str]
    categorical: list[str]
    parties: list[list[str]]                 # source columns of each party, in feature order
    label: str | Column                      # a column name (second sorted category = 1) or a 0/1 Column
    order_by: list[str]                      # input order for the row id (must be total)
    fractions: tuple = (0.1, 0.1)
    names: tuple = ("tr", "va", "te")
    seed: int = 0
    fit_on: str = "all"                      # "all", "train", or "not_test" (the training file)
    holdout: bool = False                    # second fraction cut from the held-out part
    presplit: str | None = None              # column holding names[-1] for rows of a separate test file
    extra: dict = field(default_factory=dict)


def _features(cols: list[str], spec: PrepSpec, fitted: dict) -> Column:
    parts = []
    for c in cols:
        if c in spec.numeric:
            lo, hi = fitted["ranges"][c]
            parts.append(F.array(prep.minmax(c, lo, hi)))
        else:
            parts.append(prep.onehot(c, fitted["categories"][c]))
    return F.concat(*parts)


def prepare_vertical(df: DataFrame, spec: PrepSpec) -> tuple[DataFrame, DataFrame, dict]:
    """Returns (parties long form ``(uid, split, party, features)``, labels ``(uid, split, y)``,
    fitted encoders)."""
    label_cats = None
    if isinstance(spec.label, str):
        cat_cols = list(dict.fromkeys(spec.categorical + [spec.label]))
    else:
        cat_cols = spec.categorical
    indexed = dense_index(df, spec.order_by, out="uid")
    if spec.presplit:
        # rows of the separate test file keep that split; the others are cut by the fractions
        test = F.col(spec.presplit) == F.lit(spec.names[-1])
        split = seeded_split(indexed.filter(~test), "uid", spec.fractions, spec.names[:-1], seed=spec.seed,
                             holdout=spec.holdout).unionByName(
            indexed.filter(test).withColumn("split", F.lit(spec.names[-1])))
    else:
        split = seeded_split(indexed, "uid", spec.fractions, spec.names, seed=spec.seed, holdout=spec.holdout)
    if spec.fit_on == "all":
        fit_rows = split
    elif spec.fit_on == "not_test":
        fit_rows = split.filter(F.col("split") != spec.names[-1])
    else:
        fit_rows = split.filter(F.col("split") == spec.names[0])
    fitted = prep.fit_table(fit_rows, spec.numeric, cat_cols)
    if isinstance(spec.label, str):
        label_cats = fitted["categories"][spec.label]
        y = prep.positive_label(spec.label, label_cats)
    else:
        y = spec.label
    entries = F.array(*[F.struct(F.lit(p).alias("party"), _features(cols, spec, fitted).alias("features"))
                        for p, cols in enumerate(spec.parties)])
    parties = split.select("uid", "split", F.explode(entries).alias("e")).select(
        "uid", "split", F.col("e.party").alias("party"), F.col("e.features").alias("features"))
    labels = split.select("uid", "split", y.cast("int").alias("y"))
    return parties, labels, fitted


def write_vertical(parties: DataFrame, labels: DataFrame, path: str, n_parties: int) -> None:
    """One dataset per party (partitioned by split) in one write, and the labels.

    The folder must not hold anything else: the write replaces it.
    """
    (parties.filter(F.col("party") < n_parties).select("uid", "features", "party", "split")
     .write.mode("overwrite").partitionBy("party", "split").parquet(path))
    io.write_labels(labels, path)


# ------------------------------------------------------------------ registered query

# fixed values: test-query parameters
PREP_SPEC = dict(numeric=["o_totalprice", "o_custkey"], categorical=["o_orderpriority"],
                 parties=[["o_totalprice"], ["o_orderpriority"], ["o_custkey"]], label="o_orderstatus",
                 order_by=["o_orderkey"], seed=3)


@register("prepare_parties", """
WITH ix AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS uid FROM orders),
sp0 AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || uid::VARCHAR), uid) - 1 AS sr, count(*) OVER () AS sn FROM ix),
sp AS (SELECT *, CASE WHEN sr < sn - ceil(sn * 0.1) - ceil((sn - ceil(sn * 0.1)) * 0.1) THEN 'tr'
                      WHEN sr < sn - ceil(sn * 0.1) THEN 'va' ELSE 'te' END AS split FROM sp0),
r AS (SELECT min(o_totalprice) lp, max(o_totalprice) hp, min(o_custkey)::DOUBLE lc, max(o_custkey)::DOUBLE hc FROM orders),
k AS (SELECT list(v ORDER BY v) cats FROM (SELECT DISTINCT coalesce(o_orderpriority, 'missing') v FROM orders)),
ks AS (SELECT list(v ORDER BY v) cats FROM (SELECT DISTINCT coalesce(o_orderstatus, 'missing') v FROM orders)),
f AS (SELECT uid, split,
             (o_orderstatus = ks.cats[2])::INTEGER AS y,
             [(o_totalprice - lp) / (hp - lp)] AS f0,
             list_transform(k.cats, lambda c: (c = coalesce(o_orderpriority, 'missing'))::DOUBLE) AS f1,
             [(o_custkey - lc) / (hc - lc)] AS f2
      FROM sp, r, k, ks)
SELECT uid, split, p::INTEGER AS party, y,
       list_transform(CASE p WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END, lambda v: round(v, 6)) AS features
FROM f, range(0, 3) t(p)
""")
def prepare_parties_q(spark, sf_dir):
    """Entry 1: orders -> row ids in key order, exact seeded split, encoders fitted on all rows,
    three parties (price / priority one-hot / customer key), label = second status category."""
    orders = read_table(spark, sf_dir, "orders")
    parties, labels, _ = prepare_vertical(orders, PrepSpec(**PREP_SPEC))
    return (parties.join(labels.drop("split"), "uid")
            .select("uid", "split", "party", "y",
                    F.transform("features", lambda v: round6(v)).alias("features")))
