"""Column expressions shared by the sources and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code of each circuit type.
CIRCUIT_TYPE_CODES = {"Permanent": 0, "Street": 1, "Unknown": 2}

# What a circuit without known features counts as.
UNKNOWN_CIRCUIT = {"circuit_type": "Unknown", "circuit_length": 5.0}

# The weather assumed where there is no forecast.
DEFAULT_WEATHER = {
    "temperature": 25.0,
    "description": "Unknown",
    "is_wet": False,
    "rain_chance": 0.0,
}

# Degrees where a dry track stops being cool, and moderate.
COOL_BELOW, HOT_FROM = 20, 30


def full_name(given: Column, family: Column) -> Column:
    return F.concat_ws(" ", given, family)


def digits_to_int(text: Column) -> Column:
    """An integer from text made of digits only; anything else is NULL."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def parse_day(text: Column) -> Column:
    """A date from year-month-day text, zero-padded or not; null from any other text."""
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def win_flag(finish: Column) -> Column:
    """1 for a first place, otherwise 0, also where the finish is unknown."""
    return finish.eqNullSafe(F.lit(1)).cast("int")


def circuit_type_code(circuit_type: Column) -> Column:
    pairs = [F.lit(part) for item in CIRCUIT_TYPE_CODES.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), circuit_type)


def percent_to_fraction(percent: Column) -> Column:
    return percent.cast("double") / F.lit(100.0)


def days_until(day: Column, as_of: str) -> Column:
    return F.datediff(day, F.lit(as_of).cast("date"))


def track_condition(temperature: Column, is_wet: Column) -> Column:
    return (
        F.when(is_wet, F.lit("Wet"))
        .when(temperature < COOL_BELOW, F.lit("Cool"))
        .when(temperature < HOT_FROM, F.lit("Moderate"))
        .otherwise(F.lit("Hot"))
    )


def finite_or_zero(value: Column) -> Column:
    """0 in place of NULL, NaN and both infinities."""
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def stable_hash(seed: int, *parts: Column, hex_digits: int = 8) -> Column:
    """A whole number below 16**hex_digits that depends on the values alone.

    Equal on every engine with md5, and the same however rows are partitioned.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")
