"""Pull-request and code-quality analytics as Spark DataFrame jobs."""
