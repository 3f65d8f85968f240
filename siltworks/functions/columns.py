"""Select, round and stamp helpers used by the layer operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def conform(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the named columns and rename them."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns in place."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def stamped(df: DataFrame, column: str) -> DataFrame:
    """Add the audit timestamp."""
    return df.withColumn(column, F.current_timestamp())


def constant(text: str, like: T.DataType) -> Column:
    """A number that stays decimal next to decimals and is a double otherwise."""
    return F.expr(text) if isinstance(like, T.DecimalType) else F.lit(float(text))


def mean(total: Column, n: Column) -> Column:
    """Average from a sum and a count; NULL for an empty group."""
    return F.try_divide(total, n)
