"""Steps of long expression chains that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind an ``inline`` of one row.

    The optimizer doesn't merge expressions across it, so later steps read the
    values instead of repeating (and doubling) the expressions that made them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
