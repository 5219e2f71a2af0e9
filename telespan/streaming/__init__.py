"""Structured Streaming versions of ingestion, rates, alerts and baselines."""
