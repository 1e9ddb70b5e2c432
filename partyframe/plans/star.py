"""Test-data roles: entity = order, three parties, binary and 3-class labels.

* party 0 (orders):   minmax(o_totalprice) + one-hot(o_orderpriority)      -> 6
* party 1 (customer): minmax(c_acctbal) + one-hot(c_mktsegment), by o_custkey -> 6
* party 2 (lineitem): minmax of sum(l_quantity), avg(l_discount), max(l_linenumber)
  per order -> 3; orders without line items get zeros at alignment.
* labels: y = (o_orderstatus = 'F'); cls = index of o_orderstatus in sorted order.

Fits are taken on each party's own sample-level rows (``fit_on='all'`` of the
reference).  Each fit is one aggregation returning a small checked value.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.operators import align, prep
from partyframe.sources.tables import read_table

WIDTHS = (6, 6, 3)


@dataclass
class Star:
    parties: list[DataFrame]     # (uid, features)
    labels: DataFrame            # (uid, y, cls)
    status_categories: list[str]


def build_star(spark: SparkSession, sf_dir: str) -> Star:
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    lineitem = read_table(spark, sf_dir, "lineitem")

    # party 1 rows: the customer columns of each order
    p1_rows = orders.select("o_orderkey", "o_custkey").join(
        customer.select("c_custkey", "c_acctbal", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"), "inner")
    # party 2 rows: line items aggregated per order (partial aggregation before the shuffle)
    li = lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"),
        F.max("l_linenumber").cast("double").alias("maxline"))

    # one aggregation per table; the three independent fit jobs run concurrently
    with ThreadPoolExecutor(max_workers=3) as pool:
        f0 = pool.submit(prep.fit_table, orders, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
        f1 = pool.submit(prep.fit_table, p1_rows, ["c_acctbal"], ["c_mktsegment"])
        f2 = pool.submit(prep.fit_table, li, ["qty", "disc", "maxline"], [])
        fit0, fit1, fit2 = f0.result(), f1.result(), f2.result()

    cats0 = fit0["categories"]["o_orderpriority"]
    lo0, hi0 = fit0["ranges"]["o_totalprice"]
    p0 = align.party_features(orders, "o_orderkey", [
        F.array(prep.minmax("o_totalprice", lo0, hi0)), prep.onehot("o_orderpriority", cats0)])

    cats1 = fit1["categories"]["c_mktsegment"]
    lo1, hi1 = fit1["ranges"]["c_acctbal"]
    p1 = align.party_features(p1_rows, "o_orderkey", [
        F.array(prep.minmax("c_acctbal", lo1, hi1)), prep.onehot("c_mktsegment", cats1)])

    r2 = fit2["ranges"]
    p2 = align.party_features(li, "l_orderkey", [F.array(*[prep.minmax(c, *r2[c]) for c in ("qty", "disc", "maxline")])])

    status = fit0["categories"]["o_orderstatus"]
    labels = orders.select(
        F.col("o_orderkey").alias("uid"),
        (F.col("o_orderstatus") == F.lit("F")).cast("int").alias("y"),
        (F.array_position(F.array(*[F.lit(s) for s in status]), F.col("o_orderstatus")) - 1)
        .cast("int").alias("cls"))
    return Star([p0, p1, p2], labels, status)


def aligned(star: Star, labels: DataFrame | None = None) -> DataFrame:
    """J1 + J2: (uid, x0, x1, x2, y, cls), with what else ``labels`` carries (splits, batch numbers).

    Splits and batches are numbered on the labels, before the parties' wide rows meet them.
    """
    al = align.align_parties(list(zip(star.parties, WIDTHS)))
    return al.join(star.labels if labels is None else labels, "uid", "inner")


def sql_mm(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} <> {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE {x} - {lo} END)"


def _onehot_sql(cats: str, v: str) -> str:
    return f"list_transform({cats}, lambda c: (c = coalesce({v}::VARCHAR, 'missing'))::DOUBLE)"


SQL_STAR = f"""
r0 AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
k0 AS (SELECT list(v ORDER BY v) cats FROM (SELECT DISTINCT coalesce(o_orderpriority::VARCHAR, 'missing') v FROM orders)),
p0 AS (SELECT o_orderkey AS uid, [{sql_mm('o_totalprice', 'lo', 'hi')}] || {_onehot_sql('cats', 'o_orderpriority')} AS f
       FROM orders, r0, k0),
c1 AS (SELECT o_orderkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
r1 AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM c1),
k1 AS (SELECT list(v ORDER BY v) cats FROM (SELECT DISTINCT coalesce(c_mktsegment::VARCHAR, 'missing') v FROM c1)),
p1 AS (SELECT o_orderkey AS uid, [{sql_mm('c_acctbal', 'lo', 'hi')}] || {_onehot_sql('cats', 'c_mktsegment')} AS f
       FROM c1, r1, k1),
l2 AS (SELECT l_orderkey, sum(l_quantity) qty, avg(l_discount) disc, max(l_linenumber)::DOUBLE maxline
       FROM lineitem GROUP BY l_orderkey),
r2 AS (SELECT min(qty) lq, max(qty) hq, min(disc) ld, max(disc) hd, min(maxline) lm, max(maxline) hm FROM l2),
p2 AS (SELECT l_orderkey AS uid,
              [{sql_mm('qty', 'lq', 'hq')}, {sql_mm('disc', 'ld', 'hd')}, {sql_mm('maxline', 'lm', 'hm')}] AS f
       FROM l2, r2),
ks AS (SELECT list(v ORDER BY v) cats FROM (SELECT DISTINCT o_orderstatus v FROM orders)),
lab AS (SELECT o_orderkey AS uid, (o_orderstatus = 'F')::INTEGER AS y,
               (list_position(cats, o_orderstatus) - 1)::INTEGER AS cls FROM orders, ks),
al AS (SELECT p0.uid, p0.f AS x0,
              coalesce(p1.f, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS x1,
              coalesce(p2.f, [0.0, 0.0, 0.0]::DOUBLE[]) AS x2, lab.y, lab.cls
       FROM p0 LEFT JOIN p1 ON p0.uid = p1.uid LEFT JOIN p2 ON p0.uid = p2.uid JOIN lab ON lab.uid = p0.uid)
"""
