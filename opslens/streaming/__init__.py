"""Continuous jobs: each polling loop as a Structured Streaming query."""
