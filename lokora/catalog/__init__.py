"""All registered queries, by name."""

from lokora.catalog import corpus_queries, source_queries, vocab_queries  # noqa: F401
from lokora.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
