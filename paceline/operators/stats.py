"""Grouped statistics over results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import win_flag
from paceline.schemas import CIRCUIT_STATS


def circuit_stats(results: DataFrame) -> DataFrame:
    """Each driver's record over ``results``, which hold one circuit's races; rows without a driver are no one's."""
    wins = F.coalesce(F.sum(win_flag(F.col("finish"))), F.lit(0))
    races = F.count("race_date")
    return results.filter(F.col("driver_id").isNotNull()).groupBy("driver_id").agg(
        F.avg("finish").alias("avg_finish_circuit"),
        F.min("finish").alias("best_finish_circuit"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("total_points_circuit"),
        wins.alias("wins_circuit"),
        races.alias("races_at_circuit"),
        F.try_divide(wins, races).alias("win_rate_circuit"),
    )


def circuit_stats_or_overall(at_circuit: DataFrame, overall: DataFrame) -> DataFrame:
    """Circuit record, from the overall results if the circuit has none at all."""
    return circuit_stats(overall if at_circuit.isEmpty() else at_circuit)


def circuit_stats_as_of(results: DataFrame) -> DataFrame:
    """``results`` with each driver's record at that row's circuit on earlier days.

    Reduced to one row per (driver, circuit, day) before the window.
    """
    keys = ["driver_id", "circuit_id"]
    daily = results.groupBy(*keys, "race_date").agg(
        F.sum("finish").alias("finish_sum"),
        F.count("finish").alias("finish_n"),
        F.min("finish").alias("finish_min"),
        F.sum("points").alias("points_sum"),
        F.sum(win_flag(F.col("finish"))).alias("win_sum"),
        F.count("*").alias("n"),
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)
    )

    def total(name):
        return F.sum(name).over(earlier)

    known = daily.select(
        *keys,
        "race_date",
        F.try_divide(total("finish_sum"), total("finish_n")).alias("avg_finish_circuit"),
        F.min("finish_min").over(earlier).alias("best_finish_circuit"),
        total("points_sum").alias("total_points_circuit"),
        total("win_sum").alias("wins_circuit"),
        F.try_divide(total("win_sum"), total("n")).alias("win_rate_circuit"),
    )
    assert set(CIRCUIT_STATS) <= set(known.columns)
    return results.join(known, [*keys, "race_date"])


def average_grid(results: DataFrame) -> DataFrame:
    return results.filter(F.col("driver_id").isNotNull()).groupBy("driver_id").agg(F.avg("grid").alias("avg_grid"))


def winners(results: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each group in ``order`` (NULL last).

    A minimum over structs, so each task sends on one row per group.
    """
    rank = [F.struct(F.col(c).isNull(), F.col(c)).alias(f"by_{c}") for c in order]
    first = F.min(F.struct(*rank, *columns))
    return (
        results.groupBy(*keys)
        .agg(first.alias("first"))
        .select(*keys, *[F.col(f"first.{c}").alias(c) for c in columns])
    )


def standings(results: DataFrame, keys: list[str]) -> DataFrame:
    """Points and wins summed over ``keys``."""
    return results.groupBy(*keys).agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.sum(win_flag(F.col("finish"))).alias("wins"),
    )
