"""Market and text analytics as Spark jobs."""
