"""A PySpark-native analytics engine for text-knowledge corpora."""
