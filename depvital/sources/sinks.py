"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """CSV folder with a header; absent values are empty. Ordering is a distributed range sort."""
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """JSON lines folder; NULL fields are left out."""
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.mode("overwrite").option("ignoreNullFields", True).json(path)
