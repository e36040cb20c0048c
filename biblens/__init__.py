"""Spark-native auditing of bibliographic references."""
