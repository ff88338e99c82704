"""Models on pyspark.ml with temporal selection."""
