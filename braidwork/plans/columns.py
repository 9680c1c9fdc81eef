"""Column selection that survives clashing names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def take(df: DataFrame, **named: str | Column) -> DataFrame:
    """Exactly the named columns, under internal names, whatever else the table holds."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in named.items()])
