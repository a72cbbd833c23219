"""tallyspark.ml."""
