"""Street-coverage analytics as PySpark DataFrame jobs."""
