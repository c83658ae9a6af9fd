"""Spark-native metrics engine for subscription businesses."""
