"""irspark: a PySpark-native engine for corpus building, retrieval and IR evaluation."""
