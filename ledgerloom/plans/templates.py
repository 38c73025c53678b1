"""Analytic templates over sales and quality tables.

Every template takes the table and the day it is asked on; nothing reads the clock and no
user text becomes part of a statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.numbers import exact_mean
from ledgerloom.operators.sla import quality_rollup  # noqa: F401  (template "quality rollup")


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def _month(as_of: str, back: int = 0) -> Column:
    return F.trunc(F.add_months(_day(as_of), -back), "month")


def _revenue() -> Column:
    return F.sum("revenue").cast("double")


def top_regions(sales: DataFrame, as_of: str, period: str = "last month", limit: int = 100) -> DataFrame:
    """Revenue by region for the last calendar month or the month so far."""
    if period == "last month":
        rows = sales.filter((F.col("sale_date") >= _month(as_of, 1)) & (F.col("sale_date") < _month(as_of)))
    else:
        rows = sales.filter(F.col("sale_date") >= _month(as_of))
    grouped = rows.groupBy("region").agg(_revenue().alias("total_revenue"))
    return grouped.orderBy(F.desc("total_revenue"), "region").limit(limit)


def flows_below(measurements: DataFrame, threshold: float = 4.5, limit: int = 100) -> DataFrame:
    grouped = measurements.groupBy("pipeline_id").agg(
        exact_mean(F.col("sigma_level")).alias("avg_sigma"), F.count(F.lit(1)).alias("runs")
    )
    return grouped.filter(F.col("avg_sigma") < threshold).orderBy("avg_sigma", "pipeline_id").limit(limit)


def daily_revenue(sales: DataFrame, as_of: str, days: int = 30, limit: int | None = 100) -> DataFrame:
    rows = sales.filter(F.col("sale_date") >= F.date_sub(_day(as_of), days))
    grouped = rows.groupBy(F.col("sale_date").alias("day")).agg(_revenue().alias("revenue")).orderBy(F.desc("day"))
    return grouped if limit is None else grouped.limit(limit)


def scan(table: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The first rows in a fixed order."""
    return table.orderBy(*order).limit(limit)


def region_sales_last_month(sales: DataFrame, as_of: str) -> DataFrame:
    rows = sales.filter((F.col("sale_date") >= _month(as_of, 1)) & (F.col("sale_date") < _month(as_of)))
    grouped = rows.groupBy("region").agg(_revenue().alias("total_revenue"), F.count(F.lit(1)).alias("orders"))
    return grouped.orderBy(F.desc("total_revenue"), "region").limit(20)


def top_products(sales: DataFrame, products: DataFrame, limit: int = 10) -> DataFrame:
    """Products by revenue; names are joined to the few rows that are shown."""
    grouped = sales.groupBy("product_id").agg(_revenue().alias("revenue"))
    top = grouped.orderBy(F.desc("revenue"), "product_id").limit(limit)
    named = top.join(products, "product_id").select("product_id", "product_name", "revenue")
    return named.orderBy(F.desc("revenue"), "product_id")


def top_regions_30_days(sales: DataFrame, as_of: str) -> DataFrame:
    rows = sales.filter(F.col("sale_date") >= F.date_sub(_day(as_of), 30))
    grouped = rows.groupBy("region").agg(_revenue().alias("total"))
    return grouped.orderBy(F.desc("total"), "region").limit(5)


def region_sales_since_last_month(sales: DataFrame, as_of: str) -> DataFrame:
    """Only a lower bound: sales after ``as_of`` count as well."""
    rows = sales.filter(F.col("sale_date") >= _month(as_of, 1))
    return rows.groupBy("region").agg(_revenue().alias("total")).orderBy(F.desc("total"), "region")
