"""Spark-native telemetry analytics, answer scoring and corpus preparation."""
