"""Costly columns that must be computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-element explode.

    The optimizer moves a filter on a plain computed column below it by repeating the whole
    expression inside the filter, once per reference. It never moves one below a generator,
    so text is normalised and matched a single time whatever is filtered later.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", packed.alias("_once")).select(
        *kept, *[F.col(f"_once.{n}").alias(n) for n in columns]
    )
