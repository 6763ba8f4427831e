"""Readers and writers of captured telemetry."""
