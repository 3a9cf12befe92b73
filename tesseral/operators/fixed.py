"""Fixed operators on a price and a quantity column: each is one scan with its filter pushed down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_gt(df: DataFrame, threshold: float, price: str = "price", quantity: str = "quantity") -> DataFrame:
    """Both columns of the rows whose price is over the threshold."""
    return df.where(F.col(price) > threshold).select(price, quantity)


def project_columns(df: DataFrame, **wanted: bool) -> DataFrame:
    """The columns whose flag is set."""
    return df.select(*[name for name, on in wanted.items() if on])


def _revenue(price: str, quantity: str) -> Column:
    return (F.col(price) * F.col(quantity)).alias("revenue")


def revenue(df: DataFrame, threshold: float, price: str = "price", quantity: str = "quantity") -> DataFrame:
    return df.where(F.col(price) > threshold).select(_revenue(price, quantity))


def revenue_and_adjusted(df: DataFrame, threshold: float, less: float = 10.0, price: str = "price", quantity: str = "quantity", keys: tuple[str, ...] = ()) -> DataFrame:
    """Revenue and the price less a constant, from one pass; ``keys`` go along."""
    return df.where(F.col(price) > threshold).select(*keys, _revenue(price, quantity), (F.col(price) - less).alias("adjusted"))


def peek(df: DataFrame, rows: int = 4) -> DataFrame:
    """A few rows to look at."""
    return df.limit(rows)
