"""Sliding-window counts of calls for service, as batch and streaming Spark jobs."""
