"""Route and pass-play analytics as PySpark DataFrame jobs."""
