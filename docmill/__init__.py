"""Document ingestion, hybrid retrieval and chat analytics as Spark jobs."""
