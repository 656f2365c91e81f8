"""Columns that later expressions use many times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a one-row generator.

    The optimizer merges neighbouring projections and copies an expression to every place that uses it; it does not
    copy across a generator. So a long regex chain is planned and evaluated once, whatever is built upon it.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.inline(F.array(F.struct(value.alias(name)))))
