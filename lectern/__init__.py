"""Literature analytics as Spark jobs."""
