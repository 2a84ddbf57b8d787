"""Streaming anomaly analytics as Spark jobs."""
