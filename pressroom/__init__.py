"""News-reading analytics as Spark DataFrame jobs."""
