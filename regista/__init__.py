"""Spark-native analytics over parish registers and similar record collections."""
