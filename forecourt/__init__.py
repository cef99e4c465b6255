"""Review analytics for service stations, written as Spark DataFrame jobs."""
