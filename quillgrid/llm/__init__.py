"""Operators for training-data pipelines. Nothing outside this package imports it but ``__spark_entry__``."""
