"""quarrylight: a PySpark-native engine for corpus processing, retrieval and code graphs."""
