"""tallyspark.streaming."""
