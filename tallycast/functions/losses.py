"""Forecast losses as column expressions and their additive parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallycast.functions.names import QUANTILES


def pinball(actual: Column, forecast: Column, level: float) -> Column:
    """Quantile loss of one forecast."""
    miss = actual - forecast
    return F.greatest(F.lit(level) * miss, F.lit(level - 1) * miss)


def loss_parts() -> list[Column]:
    """Aggregates that add up over any grouping: pinball sums, absolute demand, absolute error, rows."""
    sales = F.col("sales").cast("double")
    parts = [F.sum(pinball(sales, F.col(q), level)).alias(f"loss_{q}") for q, level in QUANTILES.items()]
    return parts + [
        F.sum(F.abs(sales)).alias("abs_sales"),
        F.sum(F.abs(sales - F.col("q50"))).alias("abs_error"),
        F.count(F.lit(1)).alias("n_days"),
    ]


def wql_of_parts() -> Column:
    """Weighted quantile loss over a group of :func:`loss_parts` rows, NULL when there was no demand."""
    total = sum((F.sum(f"loss_{q}") for q in QUANTILES), F.lit(0.0))
    return F.try_divide(2 * total / len(QUANTILES), F.sum("abs_sales"))
