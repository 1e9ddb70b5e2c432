"""Readers and writers."""

from partyframe.sources.tables import TABLES, read_table, read_tables  # noqa: F401
