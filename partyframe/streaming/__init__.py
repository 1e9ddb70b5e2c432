"""Structured Streaming: incremental best-epoch / early-stop tracking over a metric log."""
