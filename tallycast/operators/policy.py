"""Inventory decisions: a periodic order-up-to policy in closed form, compared across forecast quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallycast.functions.names import HOLDING_RATE, PUBLISHED, REVIEW_PERIOD

# The policies compared and the quantile each orders up to.
POLICIES = {"p90": "q90", "p50": "q50"}


def policy_input(panel: DataFrame, forecast: DataFrame) -> DataFrame:
    """Demand, price and forecast quantiles of every series on the days the forecast covers."""
    actuals = panel.select("id", "d_num", "sales", "sell_price")
    return actuals.join(forecast.select("id", "d_num", "q10", "q50", "q90"), ["id", "d_num"])


def inventory_trace(merged: DataFrame, policies: dict[str, str] = POLICIES, review: int = REVIEW_PERIOD) -> DataFrame:
    """Inventory before and after demand on every day, per policy and series.

    Stock is raised to the summed quantile at the start of each review cycle, never lowered, and unmet
    demand is lost. With demand that is never negative the day-by-day recursion equals a running
    maximum: M = max over cycles so far of (order-up-to level + demand before that cycle), and stock is
    what of M the demand so far has left. Two running windows replace the loop.
    """
    options = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(PUBLISHED[q]).alias("order_up_to"), F.col(q).alias("target"))
        for p, q in policies.items()
    ])
    demand = F.when(F.col("sales") >= 0, F.col("sales").cast("double")).otherwise(
        F.raise_error(F.lit("the policy needs demand that is neither negative nor missing")).cast("double")
    )
    rows = merged.withColumn("demand", demand).select(
        "id", "d_num", "demand", "sell_price", F.explode(options).alias("o")
    ).select("id", "d_num", "demand", "sell_price", "o.*")
    by_day = W.partitionBy("id", "policy").orderBy("d_num")
    so_far = by_day.rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("place", F.row_number().over(by_day) - 1).withColumns(
        {"cycle": F.floor(F.col("place") / review), "through": F.sum("demand").over(so_far)}
    )
    in_cycle = W.partitionBy("id", "policy", "cycle")
    before = F.col("through") - F.col("demand")
    raised = F.when(F.col("place") % review == 0, F.greatest(F.col("level"), F.lit(0.0)) + before)
    reach = numbered.withColumn("level", F.sum("target").over(in_cycle)).withColumn(
        "reach", F.max(raised).over(so_far)
    )
    left = lambda used: F.greatest(F.round(F.col("reach") - used, 9), F.lit(0.0))
    return reach.withColumns({"inv_before": left(before), "inv_after": left(F.col("through"))}).select(
        "policy", "order_up_to", "id", "d_num", "demand", "sell_price", "inv_before", "inv_after",
        (F.col("demand") > F.col("inv_before")).cast("int").alias("stockout"),
        (F.col("inv_after") * F.col("sell_price") * F.lit(HOLDING_RATE / 365)).alias("holding_cost"),
    )


def policy_per_series(trace: DataFrame) -> DataFrame:
    return (
        trace.groupBy("policy", "order_up_to", "id")
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.sum("stockout").alias("stockout_days"),
            F.sum("holding_cost").alias("holding_cost"),
        )
        .withColumn("stockout_rate", F.col("stockout_days") / F.col("n_days"))
    )


def policy_summary(per_series: DataFrame) -> DataFrame:
    return per_series.groupBy("policy", "order_up_to").agg(
        F.count(F.lit(1)).alias("n_series"),
        F.avg("stockout_rate").alias("mean_stockout_rate"),
        F.avg("holding_cost").alias("mean_holding_cost_per_series"),
        F.sum("holding_cost").alias("total_holding_cost"),
    )


def policy_headline(summary: DataFrame, careful: str = "p90", lean: str = "p50") -> DataFrame:
    """How many times fewer stockouts the careful policy has, and at how many times the holding cost."""
    pick = lambda policy, column: F.max(F.when(F.col("policy") == policy, F.col(column)))
    return summary.agg(
        pick(careful, "mean_stockout_rate").alias("careful_stockout_rate"),
        pick(lean, "mean_stockout_rate").alias("lean_stockout_rate"),
        F.try_divide(pick(lean, "mean_stockout_rate"), pick(careful, "mean_stockout_rate")).alias("stockout_ratio"),
        F.try_divide(pick(careful, "total_holding_cost"), pick(lean, "total_holding_cost")).alias("holding_cost_ratio"),
        pick(careful, "n_series").alias("n_series"),
    )
