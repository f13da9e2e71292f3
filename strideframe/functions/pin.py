"""Compute a set of columns once, where later filters and projections cannot copy them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns through a one-element generator.

    The optimizer copies a projected expression into every later use and into pushed-down filters;
    chains of pose algebra then outgrow one generated method. A generator's output is left alone.
    """
    kept = [c for c in df.columns if c not in columns]
    box = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*kept, F.inline(box))
