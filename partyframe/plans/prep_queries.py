"""Preparation and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from partyframe.functions.numeric import round6
from partyframe.operators import align, prep
from partyframe.operators.index import assign_batches, dense_index, seeded_split, shuffled_batches
from partyframe.plans.registry import register
from partyframe.plans.star import SQL_STAR, aligned, build_star, sql_mm
from partyframe.sources.tables import normalise_names, read_table, with_source

# fixed values: test-query parameters
SPLIT_SEED = 0
BATCH = 1024
LABEL_REMAP = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}   # classes 1..7 -> 0..6
ONEHOT_FIT_MAX_SIZE = 5                                        # fit p_brand on parts with p_size <= 5


# ---------------------------------------------------------------- sources

@register("union_sources", """
SELECT c_custkey AS key, c_nationkey AS nation_key, c_acctbal AS acct_bal, 0 AS source FROM customer
UNION ALL
SELECT s_suppkey AS key, s_nationkey AS nation_key, s_acctbal AS acct_bal, 1 AS source FROM supplier
""")
def union_sources(spark, sf_dir):
    """P1 literal source column, P2 name normalisation, U1 bag union by name."""
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Key"), F.col("c_nationkey").alias("Nation Key"),
        F.col("c_acctbal").alias("Acct Bal"))
    supp = read_table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("Acct Bal"), F.col("s_suppkey").alias("Key"),
        F.col("s_nationkey").alias("Nation Key"))
    return with_source(normalise_names(cust), "source", 0).unionByName(
        with_source(normalise_names(supp), "source", 1))


# ---------------------------------------------------------------- labels

@register("label_clean", """
WITH t AS (SELECT o_orderkey, split_part(o_orderstatus || '.', '.', 1) AS status FROM orders),
k AS (SELECT v FROM (SELECT DISTINCT status v FROM t) ORDER BY v LIMIT 1 OFFSET 1)
SELECT o_orderkey, status, (status = (SELECT v FROM k))::INTEGER AS y FROM t
""")
def label_clean(spark, sf_dir):
    """P4 text before the first dot (test-file labels end in '.'); P7 positive = second sorted category."""
    t = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", prep.first_part(F.concat("o_orderstatus", F.lit(".")), ".").alias("status"))
    return t.withColumn("y", F.coalesce(F.col("status") == prep.second_category(t, "status"), F.lit(False)).cast("int"))


@register("label_threshold", "SELECT p_partkey, (p_size >= 25)::INTEGER AS y FROM part")
def label_threshold(spark, sf_dir):
    """P5: threshold a score into a 0/1 label."""
    return read_table(spark, sf_dir, "part").select("p_partkey", prep.threshold_label("p_size", 25).alias("y"))


@register("label_remap", f"""
SELECT vec_id, CASE {" ".join(f"WHEN label = {k} THEN {v}" for k, v in LABEL_REMAP.items())} ELSE label END AS y
FROM embeddings
""")
def label_remap(spark, sf_dir):
    """Remap class codes 1..7 -> 0..6; other codes unchanged."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", prep.remap("label", LABEL_REMAP).cast("int").alias("y"))


@register("label_distinct", "SELECT DISTINCT label FROM embeddings")
def label_distinct(spark, sf_dir):
    """Distinct label values."""
    return prep.distinct_values(read_table(spark, sf_dir, "embeddings"), "label")


# ---------------------------------------------------------------- numeric text

def _dirty_customer(spark, sf_dir):
    """Text-typed numeric column: the segment name where the balance is negative, else the balance as text.
    Segment is missing (null) where the balance is negative."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(F.col("c_acctbal").cast("string"))
        .alias("bal_text"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))


SQL_DIRTY = """
d AS (SELECT c_custkey,
             CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_acctbal::VARCHAR END AS bal_text,
             CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment
      FROM customer)"""


@register("numeric_parse", f"""
WITH {SQL_DIRTY}
SELECT c_custkey, bal_text FROM d WHERE bal_text IS NOT NULL AND try_cast(bal_text AS DOUBLE) IS NULL
""")
def numeric_parse(spark, sf_dir):
    """Rows whose text does not parse as a number."""
    return prep.non_numeric(_dirty_customer(spark, sf_dir), "bal_text").select("c_custkey", "bal_text")


@register("impute_mean", f"""
WITH {SQL_DIRTY}, p AS (SELECT c_custkey, try_cast(bal_text AS DOUBLE) AS bal FROM d)
SELECT c_custkey, round(coalesce(bal, (SELECT avg(bal) FROM p)), 6) AS bal FROM p
""")
def impute_mean(spark, sf_dir):
    """P9 text -> double (bad text -> null), A3 mean, P10 fill with the mean."""
    p = _dirty_customer(spark, sf_dir).select("c_custkey", prep.to_double("bal_text").alias("bal"))
    return prep.impute_mean(p, prep.fit_means(p, ["bal"])).withColumn("bal", round6("bal"))


@register("impute_constant", f"""
WITH {SQL_DIRTY}
SELECT c_custkey, coalesce(segment, 'missing') AS segment FROM d
""")
def impute_constant(spark, sf_dir):
    """Missing category -> constant token."""
    return prep.impute_constant(_dirty_customer(spark, sf_dir).select("c_custkey", "segment"), ["segment"])


# ---------------------------------------------------------------- categories

@register("category_fit", """
WITH v AS (SELECT DISTINCT 'p_type' AS col, p_type AS value FROM part
           UNION SELECT DISTINCT 'p_brand' AS col, p_brand AS value FROM part)
SELECT col, (row_number() OVER (PARTITION BY col ORDER BY value) - 1)::INTEGER AS idx, value,
       col || '_' || (row_number() OVER (PARTITION BY col ORDER BY value) - 1)::VARCHAR AS name
FROM v
""")
def category_fit(spark, sf_dir):
    """A1 sorted category dictionary per column, P3 generated names."""
    t = prep.category_table(read_table(spark, sf_dir, "part"), ["p_type", "p_brand"])
    return t.select("col", "idx", "value", F.concat_ws("_", "col", F.col("idx").cast("string")).alias("name"))


@register("onehot", f"""
WITH k AS (SELECT list(v ORDER BY v) AS cats FROM (SELECT DISTINCT p_brand v FROM part WHERE p_size <= {ONEHOT_FIT_MAX_SIZE}))
SELECT p_partkey,
       array_to_string(list_transform(cats, lambda c: (c = p_brand)::INTEGER), '') AS bits,
       (CASE WHEN list_contains(cats, p_brand) THEN list_position(cats, p_brand) - 1 ELSE -1 END)::INTEGER AS hot
FROM part, k
""")
def onehot_q(spark, sf_dir):
    """One-hot of p_brand fitted on a subset; unseen brands give all zeros (hot = -1)."""
    part = read_table(spark, sf_dir, "part")
    table = prep.category_table(part.filter(F.col("p_size") <= ONEHOT_FIT_MAX_SIZE), ["p_brand"])
    width = prep.category_sizes(table, ["p_brand"])["p_brand"]
    placed = prep.category_index(part.select("p_partkey", "p_brand"), ["p_brand"], table)
    return placed.select("p_partkey", prep.onehot_at("p_brand_idx", width).alias("oh")).select(
        "p_partkey",
        F.array_join(F.transform("oh", lambda v: v.cast("int").cast("string")), "").alias("bits"),
        (F.coalesce(F.array_position("oh", 1.0), F.lit(0)) - 1).cast("int").alias("hot"))


@register("onehot_sparse", """
WITH o AS (SELECT o_orderkey, o_totalprice, coalesce(o_custkey::VARCHAR, 'missing') AS cust,
                  coalesce(o_orderpriority, 'missing') AS prio FROM orders),
fit AS (SELECT * FROM o WHERE o_orderkey % 2 = 0),
kc AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT cust v FROM fit)),
kp AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT prio v FROM fit)),
r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, (SELECT count(*) FROM kc) AS nc, (SELECT count(*) FROM kp) AS np
      FROM fit),
x AS (SELECT o_orderkey, coalesce((o_totalprice - lo) / (hi - lo), 0) AS price, 1 + kc.i AS ci, 1 + nc + kp.i AS pi, nc, np
      FROM o CROSS JOIN r LEFT JOIN kc ON kc.v = cust LEFT JOIN kp ON kp.v = prio)
SELECT o_orderkey, (1 + nc + np)::BIGINT AS size,
       list_filter([CASE WHEN price <> 0 THEN 0 END, ci, pi]::BIGINT[], lambda v: v IS NOT NULL) AS indices,
       list_filter([CASE WHEN price <> 0 THEN round(price, 6) END, CASE WHEN ci IS NOT NULL THEN 1 END,
                    CASE WHEN pi IS NOT NULL THEN 1 END]::DOUBLE[], lambda v: v IS NOT NULL) AS vals
FROM x
""")
def onehot_sparse(spark, sf_dir):
    """P12 without a bound on categories: price, customer and priority of every order as sparse features.

    Encoders come from the orders with even keys; a customer that those do not have gives no entry.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority")
    fit_rows, cats = orders.filter(F.col("o_orderkey") % 2 == 0), ["o_custkey", "o_orderpriority"]
    lo, hi = prep.fit_ranges(fit_rows, ["o_totalprice"])["o_totalprice"]
    table = prep.category_table(fit_rows, cats)
    sizes = prep.category_sizes(table, cats)
    row = prep.sparse_row([(F.lit(0), prep.minmax("o_totalprice", lo, hi), 1),
                           *[(F.col(f"{c}_idx"), None, sizes[c]) for c in cats]])
    placed = prep.category_index(orders, cats, table).select("o_orderkey", row.alias("f"))
    return placed.select("o_orderkey", "f.size", "f.indices",
                         F.transform("f.values", lambda v: round6(v)).alias("vals"))


# ---------------------------------------------------------------- ranges

@register("minmax_fit", """
SELECT 'p_size' AS col, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part
UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part
UNION ALL SELECT 'p_const', min(floor(p_size / 100))::DOUBLE, max(floor(p_size / 100))::DOUBLE FROM part
""")
def minmax_fit(spark, sf_dir):
    """A2: min / max per column in one pass (NaN ignored), as a (col, lo, hi) table."""
    return _ranges_frame(read_table(spark, sf_dir, "part"))


def _part_cols():
    return [("p_size", F.col("p_size")), ("p_retailprice", F.col("p_retailprice")),
            ("p_const", F.floor(F.col("p_size") / 100))]


def _part_ranges(part):
    return prep.fit_ranges(part, _part_cols())


def _ranges_frame(part):
    aggs = []
    for name, expr in _part_cols():
        x = F.when(~F.isnan(expr.cast("double")), expr.cast("double"))
        aggs.append(F.struct(F.lit(name).alias("col"), F.min(x).alias("lo"), F.max(x).alias("hi")))
    return part.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.col", "r.lo", "r.hi")


@register("minmax", f"""
WITH r AS (SELECT min(p_size) ls, max(p_size) hs, min(p_retailprice) lp, max(p_retailprice) hp,
                  min(floor(p_size / 100)) lc, max(floor(p_size / 100)) hc FROM part)
SELECT p_partkey, round({sql_mm('p_size', 'ls', 'hs')}, 6) AS size_mm,
       round({sql_mm('p_retailprice', 'lp', 'hp')}, 6) AS price_mm,
       round({sql_mm('floor(p_size / 100)', 'lc', 'hc')}, 6) AS const_mm
FROM part, r
""")
def minmax_q(spark, sf_dir):
    """Min-max scaling; the constant column maps to 0."""
    part = read_table(spark, sf_dir, "part")
    r = _part_ranges(part)
    cols = dict(_part_cols())
    return part.select("p_partkey", *[round6(prep.minmax(cols[c], *r[c])).alias(a) for c, a in
                                      (("p_size", "size_mm"), ("p_retailprice", "price_mm"), ("p_const", "const_mm"))])


# ---------------------------------------------------------------- index, split, batch

@register("dense_index", """
SELECT o_orderkey, (row_number() OVER (ORDER BY (o_orderdate >= TIMESTAMP '1997-01-01'), o_orderkey) - 1)::BIGINT AS uid
FROM orders
""")
def dense_index_q(spark, sf_dir):
    """Dense 0-based ids; 'test' rows (orders from 1997) continue after the 'train' rows."""
    o = read_table(spark, sf_dir, "orders")
    late = (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).cast("int")
    o = o.select("o_orderkey", late.alias("late"))
    return dense_index(o, ["late", "o_orderkey"], out="uid").select("o_orderkey", "uid")


def _split_sql(fracs, names):
    n = "n"
    rest = n
    sizes = []
    for f in fracs:
        size = f"ceil(({rest})::DOUBLE * {f})"
        sizes.append(size)
        rest = f"(({rest}) - {size})"
    bounds = [rest]
    acc = rest
    for s in reversed(sizes[1:]):
        acc = f"({acc} + {s})"
        bounds.append(acc)
    case = " ".join(f"WHEN r < {b} THEN '{nm}'" for nm, b in zip(names[:-1], bounds))
    return f"""
WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || o_orderkey::VARCHAR), o_orderkey) - 1 AS r,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE {case} ELSE '{names[-1]}' END AS split FROM t
"""


@register("split_two", _split_sql((0.1,), ("tr", "te")))
def split_two(spark, sf_dir):
    """Exact-size seeded split (10 % test)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return seeded_split(o, "o_orderkey", (0.1,), ("tr", "te"), seed=SPLIT_SEED)


@register("split_three", _split_sql((0.1, 0.1), ("tr", "va", "te")))
def split_three(spark, sf_dir):
    """W2 twice: test = ceil(10 % of all), validation = ceil(10 % of the rest)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return seeded_split(o, "o_orderkey", (0.1, 0.1), ("tr", "va", "te"), seed=SPLIT_SEED)


@register("batches", f"""
WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || o_orderkey::VARCHAR), o_orderkey) - 1 AS r,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (r // {BATCH})::BIGINT AS batch_id, (r % {BATCH})::INTEGER AS row_in_batch,
       least({BATCH}, n - (r // {BATCH}) * {BATCH})::INTEGER AS batch_rows
FROM t
""")
def batches_q(spark, sf_dir):
    """One seeded permutation, contiguous batches of 1024, last one short."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return shuffled_batches(o, "o_orderkey", BATCH, seed=SPLIT_SEED)


@register("batches_ordered", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS r,
                  count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, (r // {BATCH})::BIGINT AS batch_id, (r % {BATCH})::INTEGER AS row_in_batch,
       least({BATCH}, n - (r // {BATCH}) * {BATCH})::INTEGER AS batch_rows
FROM t
""")
def batches_ordered(spark, sf_dir):
    """W3 for validation / test: batches in plain key order (composite key)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return assign_batches(li, ["l_orderkey", "l_linenumber"], BATCH)


# ---------------------------------------------------------------- parties and alignment

@register("party_project", f"""
WITH {SQL_STAR}
SELECT uid, (unnest(range(0, len(f))))::INTEGER AS j, round(unnest(f), 6) AS v FROM p1
""")
def party_project(spark, sf_dir):
    """Party 1's features per order as (uid, j, v)."""
    p1 = build_star(spark, sf_dir).parties[1]
    return p1.select("uid", F.posexplode("features").alias("j", "v")).select(
        "uid", F.col("j").cast("int"), round6("v").alias("v"))


@register("align_left_zero", f"""
WITH {SQL_STAR}
SELECT uid, y, cls, (list_sum(x2) <> 0 OR uid IN (SELECT uid FROM p2))::INTEGER AS has_p2,
       round(list_sum(x0), 6) AS s0, round(list_sum(x1), 6) AS s1, round(list_sum(x2), 6) AS s2
FROM al
""")
def align_left_zero(spark, sf_dir):
    """J1 left join from party 0 with zero fill (P16), J2 label attached by key."""
    star = build_star(spark, sf_dir)
    al = aligned(star)
    p2_keys = star.parties[2].select("uid").withColumn("_in", F.lit(1))
    s = lambda c: round6(F.aggregate(c, F.lit(0.0), lambda a, v: a + v))
    return al.join(p2_keys, "uid", "left").select(
        "uid", "y", "cls", F.coalesce("_in", F.lit(0)).cast("int").alias("has_p2"),
        s("x0").alias("s0"), s("x1").alias("s1"), s("x2").alias("s2"))


@register("concat_party", f"""
WITH {SQL_STAR}
SELECT uid, (unnest(range(0, 15)))::INTEGER AS j, round(unnest(x0 || x1 || x2), 6) AS v FROM al
""")
def concat_party(spark, sf_dir):
    """All parties' features side by side, in party order, as (uid, j, v)."""
    al = aligned(build_star(spark, sf_dir))
    return al.select("uid", F.posexplode(align.concat_parties(3)).alias("j", "v")).select(
        "uid", F.col("j").cast("int"), round6("v").alias("v"))


@register("pos_weight", """
SELECT count(*)::BIGINT AS n, sum((o_orderstatus = 'F')::INTEGER)::BIGINT AS n_pos,
       (count(*) - sum((o_orderstatus = 'F')::INTEGER)) / sum((o_orderstatus = 'F')::INTEGER) AS pos_weight
FROM orders
""")
def pos_weight_q(spark, sf_dir):
    """A4: n_neg / n_pos of the binary label."""
    return align.pos_weight(build_star(spark, sf_dir).labels)


@register("class_weight", """
WITH ks AS (SELECT list(v ORDER BY v) cats FROM (SELECT DISTINCT o_orderstatus v FROM orders)),
l AS (SELECT (list_position(cats, o_orderstatus) - 1)::INTEGER AS cls FROM orders, ks)
SELECT cls, count(*)::BIGINT AS n_c, (SELECT count(*) FROM l) / count(*) AS weight FROM l GROUP BY cls
""")
def class_weight_q(spark, sf_dir):
    """N / n_c per class, ordered by class."""
    return align.class_weight(build_star(spark, sf_dir).labels, "cls")


@register("class_weight_embeddings", """
SELECT label, count(*)::BIGINT AS n_c, (SELECT count(*) FROM embeddings) / count(*) AS weight
FROM embeddings GROUP BY label
""")
def class_weight_embeddings(spark, sf_dir):
    """A5 on the 10-class embedding labels."""
    return align.class_weight(read_table(spark, sf_dir, "embeddings"), "label")
