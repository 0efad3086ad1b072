"""A Spark-native analytics engine for web pages, keywords and search performance."""
