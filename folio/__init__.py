"""A PySpark-native engine for document retrieval and question answering in batches."""
