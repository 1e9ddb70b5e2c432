"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's gate: row count, column names, order-insensitive values
(doubles compared after rounding to 6 significant places of tolerance).
Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None      # a null in a pandas numeric column (Spark and DuckDB differ there)
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except Exception:  # noqa: BLE001
        pass
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, builder, sql, sf_dir):
    t0 = time.time()
    sdf = builder(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(spdf), ok=None, spark_s=round(t1 - t0, 2))
    dpdf = con.execute(sql).df()
    scols, srows = rows_of(spdf)
    dcols, drows = rows_of(dpdf)
    res = dict(name=name, rows=len(spdf), oracle_rows=len(dpdf), spark_s=round(t1 - t0, 2))
    if scols != dcols:
        res.update(ok=False, why=f"columns {scols} vs {dcols}")
        return res
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = dict(zip(dpdf.columns, [str(t) for t in dpdf.dtypes]))
    res["types"] = {c: (stypes[c], dtypes[c]) for c in scols}
    if len(srows) != len(drows):
        res.update(ok=False, why="row count")
        return res
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    res.update(ok=not bad, why=(f"{len(bad)} differing rows, first {bad[0]}" if bad else ""))
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from partyframe.session import get_spark
    import __spark_entry__ as E
    spark = get_spark(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            r = dict(name=name, ok=False, why=f"{type(exc).__name__}: {str(exc)[:400]}")
        failed += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
