"""A Spark-first engine for preparing typed data and running learners on it."""
