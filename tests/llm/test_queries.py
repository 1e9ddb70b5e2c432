"""Registered queries: SQL twins, and the contracts that SQL cannot state."""

import zlib

import pytest

from partyframe.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    r = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLE_SQL[name], SF_SMALL)
    assert r["ok"], r


@pytest.mark.parametrize("name,columns", [
    ("op1_quality", "doc_id n_tokens perplexity threshold kept"),
    ("op2_language", "doc_id held_out lang_pred score"),
    ("op5_toxicity", "doc_id held_out score predicted"),
    ("op7_katz", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    ("op9_sharding", "doc_id size text_crc32 law shard slot grown_shard")])
def test_one_row_per_document(spark, name, columns):
    df = QUERIES[name](spark, SF_SMALL)
    assert set(columns.split()) <= set(df.columns)
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == ids
    if "held_out" in df.columns:
        want = 1 if name == "op7_katz" else 0
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == want) for r in rows)
    if name == "op7_katz":
        assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op2_language"](spark, SF_SMALL).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
