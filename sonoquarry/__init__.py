"""Spark-first retrieval, evaluation and data-preparation operators over embedded catalogue items."""

__version__ = "0.1.0"
