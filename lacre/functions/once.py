"""Expressions that are planned and evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, **cols: Column) -> DataFrame:
    """withColumns behind a generator, through which neither filters nor projections are pushed: an expensive column
    that is used several times afterwards isn't copied into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
