"""Readers and writers: telemetry, flow logs, flow counts, counters, probes, runs."""
