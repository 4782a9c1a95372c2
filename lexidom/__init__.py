"""Domain-name text analytics as Spark DataFrame jobs."""
