"""Spark-native preparation of text corpora for language-model training."""
