"""tallyspark.operators."""
