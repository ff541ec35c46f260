"""A PySpark-native engine for content reduction and usage analytics over LLM agent tables."""
