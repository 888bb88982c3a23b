"""Personal-data inventory and erasure coverage as Spark jobs."""
