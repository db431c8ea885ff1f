"""Point-in-time reliability analytics as ordinary Spark DataFrame jobs."""
