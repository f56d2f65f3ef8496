"""Spark-native frame, people and corpus analytics."""
