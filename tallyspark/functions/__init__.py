"""tallyspark.functions."""
