"""Glyphora: a Spark-native engine for annotated corpora and training-data preparation."""
