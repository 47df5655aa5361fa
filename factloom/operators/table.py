"""A columnar table of appended rows: scans by row number, rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_range(table: DataFrame, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last``, both included; ValueError for a reversed range, IndexError beyond the table."""
    if first > last:
        raise ValueError("first row after last")
    if first < 0 or last >= table.count():
        raise IndexError("row out of bounds")
    return table.where(F.col("row_id").between(first, last))


def last_value(table: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """The value of ``column`` in the last row, by the row number or by another column that has its order; no row for an empty table."""
    return table.agg(F.max_by(column, order).alias(column), F.count(F.lit(1)).alias("n")).where("n > 0").select(column)


def by_key(table: DataFrame, key: str, order: str = "row_id") -> DataFrame:
    """The latest row of each key; earlier ones stay in the columns but are no longer found."""
    return table.groupBy(key).agg(F.max_by(F.struct(*(c for c in table.columns if c != key)), order).alias("row")).select(key, "row.*")


def scan_average(table: DataFrame, where: Column, column: str) -> DataFrame:
    """Average and number of a column's values over a filter; the filter reaches the file scan."""
    return table.where(where).agg(F.avg(column).alias("average"), F.count(column).alias("n"))
