"""Spark-native screening, featurising and scoring of large tables of short posts."""
