"""A Spark-native engine for hybrid retrieval over files, and for training-text preparation."""
