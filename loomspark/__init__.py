"""A Spark-first engine for text and product analytics."""
