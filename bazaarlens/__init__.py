"""Commerce analytics written as Spark DataFrame and Spark ML jobs."""
