"""Spark-native normative deviation analytics."""
