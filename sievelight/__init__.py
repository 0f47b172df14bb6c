"""Spark-native scoring of document collections for injected instructions and corpus poisoning."""
