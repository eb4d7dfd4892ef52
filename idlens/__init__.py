"""Spark-native machine-identity risk analytics over tables of text artifacts."""
