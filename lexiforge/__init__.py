"""Spark-first engine for building, cleaning, mining and scoring text corpora."""

__version__ = "0.1.0"
