"""Forecast origins, and summing history as of every origin without copying the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallycast.functions.names import HORIZON


def last_day(panel: DataFrame) -> int:
    """The last day of a panel: one number, read from one column."""
    return panel.agg(F.max("d_num")).first()[0]


def generate_origins(
    max_day: int, horizon: int = HORIZON, n_origins: int = 5, spacing: int = HORIZON
) -> list[int]:
    """Origins in ascending order; the last one's forecast ends on ``max_day``."""
    newest = max_day - horizon
    oldest = newest - (n_origins - 1) * spacing
    if oldest < 1:
        raise ValueError(
            f"{n_origins} origins spaced {spacing} days apart with horizon {horizon} "
            f"need history before day 1 (earliest origin {oldest})"
        )
    return list(range(oldest, newest + 1, spacing))


def origins_table(panel: DataFrame, horizon: int = HORIZON, n_origins: int = 5, spacing: int = HORIZON) -> DataFrame:
    """The same origins as a lazy one-column table, with the same guard."""
    newest = F.col("max_day") - horizon
    oldest = newest - (n_origins - 1) * spacing
    return (
        panel.agg(F.max("d_num").cast("long").alias("max_day"))
        .select(
            F.when(oldest >= 1, F.sequence(oldest, newest, F.lit(spacing).cast("long")))
            .otherwise(F.raise_error(F.lit("not enough history for the requested origins")))
            .alias("all_origins")
        )
        .select(F.explode("all_origins").alias("origin"))
    )


def origin_array(origins: list[int]) -> Column:
    return F.array(*[F.lit(o).cast("long") for o in sorted(origins)])


def first_origin_from(day: Column, origins: list[int]) -> Column:
    """The earliest origin that may see a day, NULL for days after the last origin."""
    return F.array_min(F.filter(origin_array(origins), lambda o: o >= day))


def origins_from(first_origin: Column, origins: list[int]) -> Column:
    """All origins that may see rows whose earliest origin is ``first_origin``."""
    return F.explode(F.filter(origin_array(origins), lambda o: o >= first_origin))


def sums_as_of(history: DataFrame, keys: list[str], sums: dict[str, Column], origins: list[int]) -> DataFrame:
    """Sums over the history up to each origin, keyed by origin and ``keys``.

    Rows are first summed per stretch between two origins; only those partial sums are repeated per
    origin. The history itself is read and shuffled once, whatever the number of origins.
    """
    stretches = (
        history.where(F.col("d_num") <= max(origins))
        .withColumn("first_origin", first_origin_from(F.col("d_num"), origins))
        .groupBy(*keys, "first_origin")
        .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    )
    return (
        stretches.withColumn("origin", origins_from(F.col("first_origin"), origins))
        .groupBy("origin", *keys)
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def future_window(panel: DataFrame, origins: list[int], horizon: int = HORIZON) -> DataFrame:
    """The rows each origin is scored on, tagged with that origin."""
    ahead = F.filter(origin_array(origins), lambda o: (o < F.col("d_num")) & (F.col("d_num") <= o + horizon))
    in_reach = (F.col("d_num") > min(origins)) & (F.col("d_num") <= max(origins) + horizon)
    return panel.where(in_reach).withColumn("origin", F.explode(ahead))
