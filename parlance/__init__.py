"""Chat-transcript analytics as Spark jobs."""
