"""quire: a PySpark-native engine over collections of born-digital documents."""
