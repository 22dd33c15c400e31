"""Spark-native curation, evaluation and telemetry engine."""
