"""Longitudinal as-of analytics on Spark: DataFrame in, DataFrame out."""
