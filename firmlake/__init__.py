"""A PySpark-native catalogue of organisations built from crawled web data."""
