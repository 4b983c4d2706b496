"""Evaluate a costly expression once.

The optimizer copies a projected expression into every filter and projection
above it, and a value used twice inside one expression may run twice.  That is
right for cheap expressions and wrong for chains of regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that later operators read but never re-evaluate."""
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    return df.select(*kept, F.inline_outer(F.array(row))).select(*order)
