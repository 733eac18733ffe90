"""Columns that are computed once a row, however often later expressions name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of one generator: each is a method of generated code, which must stay small to be compiled.
PART = 3


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind generators of one row, into which the optimizer does not inline them.

    A chain of withColumn is merged into one projection, where an expression is copied into every place
    that names it; chains of forms grow beyond what can be compiled that way.
    """
    named = [c.alias(name) for name, c in columns.items()]
    for k in range(0, len(named), PART):
        df = df.select("*", F.inline(F.array(F.struct(*named[k : k + PART]))))
    return df
