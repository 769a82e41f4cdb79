"""Spark-native engine for messy geochemical tables, papers and site indexes."""
