"""Spark-native screening of publication records."""
