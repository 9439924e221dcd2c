"""Structured Streaming jobs of the draft life-cycle."""
