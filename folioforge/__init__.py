"""folioforge: a DataFrame-native engine for passage retrieval and corpus processing on Spark."""
