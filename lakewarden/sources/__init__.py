"""Readers of submissions, reference data, and sinks."""
