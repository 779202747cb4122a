"""Continuous profiling and rule checks with Structured Streaming."""
