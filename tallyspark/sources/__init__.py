"""tallyspark.sources."""
