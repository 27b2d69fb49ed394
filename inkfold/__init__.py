"""News-collection analytics as Spark DataFrame jobs."""
