"""quire: a PySpark-native engine for research libraries and training-text preparation."""
