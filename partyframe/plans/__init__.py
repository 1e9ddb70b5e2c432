"""Registered queries over the test tables: Spark builder + DuckDB oracle SQL side by side."""

from partyframe.plans.registry import REGISTRY, oracle_sql, queries  # noqa: F401
from partyframe.plans import codec_queries, prep_queries, model_queries, eval_queries, fit_queries, prepare  # noqa: F401,E402
