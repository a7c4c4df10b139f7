"""cairn: Spark-first retrieval, privacy and personal-data analytics."""
