"""Batch and streaming jobs that evaluate agent executions at scale, written for Spark."""
