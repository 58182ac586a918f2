"""Small sides whose size is checked before they leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class TooLarge(ValueError):
    """The side exceeds its stated bound."""


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a dimension with at most `limit` rows; more raise TooLarge, nothing is dropped.

    Only limit + 1 rows ever travel to the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what} has more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast when a checked count is within `limit`; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
