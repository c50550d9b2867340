"""Web-archive analytics expressed as Spark DataFrame jobs."""
