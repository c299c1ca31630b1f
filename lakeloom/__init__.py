"""A Spark-native engine for document preparation and hybrid retrieval analytics."""
