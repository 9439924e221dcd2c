"""Scans, derived corpora and sinks."""
