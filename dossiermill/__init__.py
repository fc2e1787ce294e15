"""Spark-native analytics over corpora of structured safety documents."""
