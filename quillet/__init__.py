"""PySpark-native engine for curating and analysing training text."""
