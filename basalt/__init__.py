"""basalt: code-security analytics and corpus preparation as Spark DataFrame jobs."""
