"""PySpark-native analytics over web pages, documents and semi-structured data."""
