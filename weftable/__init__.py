"""Spark-native extraction and analysis of tables in web articles."""
