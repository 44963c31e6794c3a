"""A Spark-first engine for de-identifying agent traces and for measuring what identity survives."""
