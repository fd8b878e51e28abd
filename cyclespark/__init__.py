"""Cycle telemetry on Spark."""
