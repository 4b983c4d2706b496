"""Spark jobs for building and evaluating software-localization parallel corpora."""

__version__ = "0.1.0"
