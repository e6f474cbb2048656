"""The tables a season analysis works on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources import dimensions
from paceline.sources.documents import read_forecasts, read_table, with_race


@dataclass
class Tables:
    """``order`` puts a driver's results in a unique order by time.

    ``results`` needs season, race_date, circuit_id, driver_id, constructor_id,
    grid, finish, points, the order columns and a unique text ``row_key``;
    ``weather`` with a day ``issued`` is taken as of the day asked about;
    of several rows of ``qualifying`` for a driver and day the lowest position counts.
    ``key`` names the columns that ``row_key`` is the text of, so that a text need not
    go along through every step; ``written`` says that ``results`` is a written table.
    """

    results: DataFrame
    qualifying: DataFrame
    drivers: DataFrame
    driver_standings: DataFrame
    constructor_standings: DataFrame
    entries: DataFrame
    calendar: DataFrame
    circuit_aliases: DataFrame
    circuit_features: DataFrame
    weather: DataFrame
    order: list[str] = field(default_factory=lambda: ["race_date", "round"])
    key: list[str] | None = None
    written: bool = False


def row_key(key: list[str]) -> Column:
    """The text that names a row."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("row_key")


def from_landing(spark: SparkSession, landing: str) -> Tables:
    """All tables from a folder of captured documents."""

    def table(kind: str) -> DataFrame:
        return read_table(spark, landing, kind)

    key = ["season", "round", "race_date", "driver_id"]
    results = table("results").withColumn("row_key", row_key(key))
    return Tables(
        results=results,
        qualifying=with_race(table("qualifying"), table("schedule")),
        drivers=table("drivers"),
        driver_standings=table("driver_standings"),
        constructor_standings=table("constructor_standings"),
        entries=table("entries"),
        calendar=dimensions.calendar(spark),
        circuit_aliases=dimensions.circuit_aliases(spark),
        circuit_features=dimensions.circuit_features(spark),
        weather=read_forecasts(spark, landing),
        key=key,
    )
