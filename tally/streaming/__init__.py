"""Structured Streaming forms of the time-series operators."""

from tally.streaming.resample import resample_stream, run_to_table, stream_table  # noqa: F401
