"""Row filters: seasons, completed races, horizons, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import days_until


def last_seasons(df: DataFrame, as_of_season: int, n: int = 3) -> DataFrame:
    """The ``n`` seasons before ``as_of_season``, which is itself left out."""
    return df.filter(F.col("season").between(as_of_season - n, as_of_season - 1))


def at_circuit(df: DataFrame, circuit_id: str) -> DataFrame:
    return df.filter(F.col("circuit_id") == circuit_id)


def completed(df: DataFrame, as_of_date: str, day: str = "race_date") -> DataFrame:
    """Races held by the end of ``as_of_date``."""
    return df.filter(F.col(day) <= F.lit(as_of_date).cast("date"))


def last_n_races(schedule: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The latest ``n`` rows of a schedule with one row per race (a top-n)."""
    return schedule.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def within_days(df: DataFrame, day: str, as_of_date: str, horizon: int) -> DataFrame:
    """Rows from today to ``horizon`` days ahead."""
    return df.filter(days_until(F.col(day), as_of_date).between(0, horizon))


def keep_members(
    df: DataFrame, keys: DataFrame, on: str | list[str], skip_if_empty: bool = False
) -> DataFrame:
    """Rows whose key is listed; with ``skip_if_empty`` an empty list keeps all.

    ``keys`` need not be distinct, and for the test should not be: then the first
    row that is read answers it.
    """
    if skip_if_empty and keys.isEmpty():
        return df
    return df.join(keys.select(on), on, "left_semi")


def latest_date_rows(df: DataFrame, day: str = "race_date") -> DataFrame:
    """Rows on the last date that occurs anywhere in ``df``."""
    return df.filter(F.col(day) == df.agg(F.max(day)).scalar())
