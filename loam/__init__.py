"""loam: a Spark-native engine for indexing code corpora and retrieving from them."""

__version__ = "0.1.0"
