"""Feature preparation.

Fits (category dictionaries, min / max, means) are one aggregation each and
return a *small, size-checked* Python value, as Spark ML estimators do; the
transforms are plain Column expressions built from that value, so they stay
in whole-stage codegen (no higher-order function, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.operators.index import dense_index

NULL_TOKEN = "missing"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ labels

def first_part(col, sep: str = ".") -> Column:
    """Text before the first ``sep``."""
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


def threshold_label(col, t) -> Column:
    """P5: ``(col >= t)`` as 0 / 1."""
    return (_c(col) >= F.lit(t)).cast("int")


def remap(col, mapping: dict) -> Column:
    """Map values; values absent from the map stay unchanged."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*items)[_c(col)], _c(col))


def positive_label(col, categories: list) -> Column:
    """1 where the value is the second category in sorted order (the reference's positive class)."""
    if len(categories) < 2:
        return F.lit(0)
    return (_c(col).cast("string") == F.lit(categories[1])).cast("int")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """P17."""
    return df.select(col).distinct()


# ------------------------------------------------------------------ numeric text

def to_double(col) -> Column:
    """Text to double; text that does not parse becomes null (never raises)."""
    return F.expr(f"try_cast({col} AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")


def non_numeric(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is present but does not parse as a number."""
    return df.filter(F.col(col).isNotNull() & to_double(col).isNull())


def fit_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """A3: column means in one aggregation (one row to the driver)."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def impute_mean(df: DataFrame, means: dict) -> DataFrame:
    """P10: fill nulls with the fitted means."""
    for c, m in means.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(m).cast("double")))
    return df


def impute_constant(df: DataFrame, cols: list[str], token: str = NULL_TOKEN) -> DataFrame:
    """Fill missing categories with a constant token."""
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(token)))
    return df


# ------------------------------------------------------------------ categories

def category_table(df: DataFrame, cols: list[str], null_token: str = NULL_TOKEN) -> DataFrame:
    """A1 as a table: ``(col, idx, value)``, values sorted as text per column.

    Distinct values come from a partial (map-side) aggregation; they are
    numbered per column by ranges (:func:`.index.dense_index`), so a column of
    any number of categories is sorted by many tasks and nothing is collected.
    """
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(null_token)).alias("value"))
        for c in cols])).alias("kv")).select("kv.col", "kv.value")
    numbered = dense_index(longf.distinct(), ["value"], out="idx", partition_by=["col"])
    return numbered.select("col", "value", F.col("idx").cast("int").alias("idx"))


def category_sizes(table: DataFrame, cols: list[str]) -> dict[str, int]:
    """Categories per column of a :func:`category_table` (one row a column to the driver)."""
    found = {r["col"]: r["n"] for r in table.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in cols}


def category_index(df: DataFrame, cols: list[str], table: DataFrame, null_token: str = NULL_TOKEN) -> DataFrame:
    """P12 by equi-joins: adds ``<col>_idx``, the value's index in ``table`` (null: a value it does not hold).

    One left join a column.  Spark broadcasts a small dictionary and
    sort-merges a large one, where AQE splits a value that many rows share.
    """
    for c in cols:
        words = table.filter(F.col("col") == c).select(F.col("value").alias("_pf_value"),
                                                       F.col("idx").alias(f"{c}_idx"))
        df = df.withColumn("_pf_key", F.coalesce(F.col(c).cast("string"), F.lit(null_token)))
        df = df.join(words, F.col("_pf_key") == F.col("_pf_value"), "left").drop("_pf_key", "_pf_value")
    return df


def sparse_row(parts: list[tuple[Column, Column | None, int]]) -> Column:
    """Features as ``STRUCT<size, indices, values>``, zeros left out.

    ``parts`` lists (index, value, width) in feature order: a category gives
    its index, no value and the size of its dictionary; a number gives index
    0, the number and 1.  Null indexes, null and NaN numbers are zeros.
    """
    cells, size = [], 0
    for at, value, width in parts:
        v = F.lit(1.0) if value is None else F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
        cells.append(F.struct((at.cast("long") + F.lit(size)).alias("i"), v.alias("v")))
        size += width
    kept = F.filter(F.array(*cells), lambda c: c["i"].isNotNull() & (c["v"] != 0))
    return F.struct(F.lit(size).cast("long").alias("size"), F.transform(kept, lambda c: c["i"]).alias("indices"),
                    F.transform(kept, lambda c: c["v"]).alias("values"))


def onehot_at(idx, size: int) -> Column:
    """P12 from an index: ``size`` 0/1 doubles, all zeros where it is null."""
    if size == 0:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda i: F.coalesce(i == _c(idx), F.lit(False)).cast("double"))


def second_category(df: DataFrame, col: str, null_token: str = NULL_TOKEN) -> Column:
    """The second value in sorted order, as a subquery (null where there is one value only)."""
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit(null_token)).alias("v"))
    first = values.agg(F.min("v").alias("v")).scalar()
    return values.filter(F.col("v") > first).agg(F.min("v").alias("v")).scalar()


def fit_categories(df: DataFrame, cols: list[str], max_categories: int = 10_000,
                   null_token: str = NULL_TOKEN) -> dict[str, list[str]]:
    """A1: sorted distinct values per column on the driver, for one-hot columns that are array literals.

    More than ``max_categories`` a column is an error: such a column is encoded by joins, at any size, with
    :func:`category_table` and :func:`category_index`.
    """
    table = category_table(df, cols, null_token)
    bound = max_categories * len(cols)
    rows = table.select("col", "idx", "value").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {max_categories} categories per column; use category_table and category_index")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in sorted(rows, key=lambda r: (r["col"], r["idx"])):
        out[r["col"]].append(r["value"])
    return out


def onehot(col, categories: list[str], null_token: str = NULL_TOKEN) -> Column:
    """One 0/1 double per fitted category; an unseen value gives all zeros."""
    v = F.coalesce(_c(col).cast("string"), F.lit(null_token))
    return F.array(*[(v == F.lit(k)).cast("double") for k in categories])


def onehot_names(col: str, categories: list[str]) -> list[str]:
    """Generated names ``<col>_<i>``."""
    return [f"{col}_{i}" for i in range(len(categories))]


# ------------------------------------------------------------------ ranges

def fit_ranges(df: DataFrame, cols: list) -> dict[str, tuple[float, float]]:
    """A2: min / max per column in one aggregation, NaN ignored."""
    named = {(c if isinstance(c, str) else c[0]): (_c(c) if isinstance(c, str) else c[1]) for c in cols}
    aggs = []
    for name, expr in named.items():
        x = expr.cast("double")
        clean = F.when(~F.isnan(x), x)
        aggs += [F.min(clean).alias(f"{name}__lo"), F.max(clean).alias(f"{name}__hi")]
    row = df.agg(*aggs).first()
    return {n: (row[f"{n}__lo"], row[f"{n}__hi"]) for n in named}


def minmax(col, lo: float, hi: float) -> Column:
    """``(x - lo) / (hi - lo)``, not clipped; a constant column maps to ``x - lo`` (so 0)."""
    x = _c(col).cast("double")
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    if hi != lo:
        return (x - F.lit(float(lo))) / F.lit(float(hi - lo))
    return x - F.lit(float(lo))


# ------------------------------------------------------------------ one-pass fit (A1 + A2 together)

def fit_table(df: DataFrame, ranges: list | None = None, categories: list[str] | None = None,
              max_categories: int = 10_000, null_token: str = NULL_TOKEN) -> dict:
    """Fit min / max (NaN ignored) and sorted category lists of one table in ONE job.

    Each row is exploded into one entry per fitted column - ``(col, category)``
    for categorical columns, ``(col, null)`` carrying the number for range
    columns - and grouped on ``(col, category)``.  The grouping is partial
    (map-side), then spread over the cluster by key, so no single task merges
    the categories of every task; only the distinct entries (bounded by the
    category check) come back.  Returns ``{"ranges": {col: (lo, hi)},
    "categories": {col: [values]}}``.
    """
    ranges = ranges or []
    categories = categories or []
    named = {(c if isinstance(c, str) else c[0]): (_c(c) if isinstance(c, str) else c[1]) for c in ranges}
    entries = []
    for name, expr in named.items():
        x = expr.cast("double")
        entries.append(F.struct(F.lit(name).alias("col"), F.lit(None).cast("string").alias("cat"),
                                F.when(~F.isnan(x), x).alias("num")))
    for c in categories:
        entries.append(F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(null_token))
                                .alias("cat"), F.lit(None).cast("double").alias("num")))
    bound = max_categories * max(1, len(categories)) + len(named)
    rows = (df.select(F.explode(F.array(*entries)).alias("e"))
            .groupBy(F.col("e.col").alias("col"), F.col("e.cat").alias("cat"))
            .agg(F.min("e.num").alias("lo"), F.max("e.num").alias("hi"))
            .limit(bound + 1).collect())
    if len(rows) > bound:
        raise ValueError(f"more than {max_categories} categories in a column; use category_table and category_index")
    cats: dict[str, list[str]] = {c: [] for c in categories}
    out_ranges = {n: (None, None) for n in named}
    for r in rows:
        if r["col"] in named and r["cat"] is None:
            out_ranges[r["col"]] = (r["lo"], r["hi"])
        elif r["col"] in cats:
            cats[r["col"]].append(r["cat"])
    for c in cats:
        cats[c] = sorted(cats[c])
        if len(cats[c]) > max_categories:
            raise ValueError(f"column {c} has more than {max_categories} categories; use category_table and category_index")
    return {"ranges": out_ranges, "categories": cats}
