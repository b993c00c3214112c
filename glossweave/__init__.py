"""glossweave: a Spark-native engine for document text processing."""
