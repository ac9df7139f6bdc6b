"""PySpark-native search and analytics over large document archives."""
