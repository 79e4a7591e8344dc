"""Page mining and article ranking as Spark DataFrame jobs."""
