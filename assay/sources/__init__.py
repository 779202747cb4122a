"""Readers, sinks, time windows and dataset listings."""
