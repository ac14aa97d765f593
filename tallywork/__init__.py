"""Job-posting ingestion, analytics, retrieval and retrieval evaluation as Spark DataFrame jobs."""
