"""Word-family analytics as Spark jobs."""
