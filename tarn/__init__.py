"""Relational analytics over ordered event logs, written for Spark's DataFrame API."""
