"""Spark-native pseudonymisation and text-data engine: every operator is a function from DataFrames to DataFrames."""
