"""The joins that turn tables into a training and a scoring matrix.

``variant`` is "faithful" or "corrected".  Faithful keeps what the original
computes although it lets a row see what it should not: form that leaks from one
driver to the next, team totals in driver order, and circuit records that
include the very race being learnt.  Corrected looks only at earlier days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import DEFAULT_WEATHER, win_flag
from paceline.operators.filters import at_circuit, keep_members, last_seasons, latest_date_rows
from paceline.operators.stats import average_grid, circuit_stats_or_overall
from paceline.operators.windows import form_carried_over, history_features, totals_as_of
from paceline.plans.tables import Tables, row_key
from paceline.schemas import CIRCUIT_STATS, FEATURES, FORM
from paceline.session import materialize
from paceline.sources.dimensions import with_circuit_features

FORM_COLUMNS = {
    "avg_points_last5": ("avg", "points"),
    "avg_finish_last5": ("avg", "finish"),
    "wins_last5": ("sum", "win"),
}
DRIVER_TOTALS = {"points_before": "points", "wins_before": "win"}
TEAM_TOTALS = {"team_points_before": "points", "team_wins_before": "win"}


def history(results: DataFrame, as_of_season: int, n: int = 3) -> DataFrame:
    """Results of the seasons before, with the win flag."""
    return last_seasons(results, as_of_season, n).withColumn("win", win_flag(F.col("finish")))


def with_form(df: DataFrame, order: list[str], variant: str = "faithful") -> DataFrame:
    if variant == "faithful":
        return form_carried_over(df, ["driver_id"], order, FORM_COLUMNS)
    return history_features(df, ["driver_id"], order, {}, FORM_COLUMNS)


def with_team_totals(df: DataFrame, order: list[str], variant: str = "faithful") -> DataFrame:
    if variant == "faithful":
        return history_features(df, ["constructor_id"], ["driver_id", *order], TEAM_TOTALS)
    return totals_as_of(df, ["constructor_id"], "race_date", TEAM_TOTALS)


def with_history_columns(df: DataFrame, order: list[str], variant: str = "faithful") -> DataFrame:
    """Driver totals, form and team totals; all drivers must still be present."""
    if variant == "faithful":
        return form_carried_over(df, ["driver_id"], order, FORM_COLUMNS, totals=DRIVER_TOTALS, within={"constructor_id": TEAM_TOTALS})
    df = with_team_totals(df, order, variant)
    return history_features(df, ["driver_id"], order, DRIVER_TOTALS, FORM_COLUMNS)


def with_qualifying(df: DataFrame, qualifying: DataFrame) -> DataFrame:
    """The race's qualifying position; the grid position if none is known at all.

    Grouped by the join's own keys, so a key occurs once and nothing is added to
    the join's shuffle.
    """
    if qualifying.isEmpty():
        return df.withColumn("qualifying_position", F.col("grid"))
    known = qualifying.groupBy("race_date", "driver_id").agg(
        F.min("position").alias("qualifying_position")
    )
    return df.join(known, ["race_date", "driver_id"], "left")


def latest_form(df: DataFrame, order: list[str], columns: list[str] = FORM) -> DataFrame:
    """Form on the last date of all, one row per driver who raced then."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("form")
    return latest_date_rows(df).groupBy("driver_id").agg(newest).select("driver_id", "form.*")


def train_matrix(
    active: DataFrame,
    stats: DataFrame | None,
    qualifying: DataFrame,
    circuit_features: DataFrame,
    key: list[str] | None = None,
) -> DataFrame:
    """One row per past result of an active driver: key, label, 18 features.

    ``stats`` is the target circuit's record per driver; without it the rows
    already carry the record at their own circuit as of their day.  ``key`` has the
    columns that make the row's key, if that is not there yet.
    """
    rows = with_qualifying(active, qualifying)
    if stats is not None:
        rows = rows.join(stats.select("driver_id", *CIRCUIT_STATS), "driver_id", "left")
    rows = with_circuit_features(rows, circuit_features)
    return rows.select(
        row_key(key) if key else "row_key",
        "driver_id",
        F.col("win").alias("label"),
        F.col("qualifying_position").cast("double").alias("qualifying_position"),
        F.col("wins_before").alias("wins"),
        F.col("points_before").alias("points"),
        F.col("team_points_before").alias("constructor_points"),
        F.col("team_wins_before").alias("constructor_wins"),
        *CIRCUIT_STATS,
        *FORM,
        "circuit_type_code",
        "circuit_length",
        F.lit(DEFAULT_WEATHER["temperature"]).alias("temperature"),
        F.lit(int(DEFAULT_WEATHER["is_wet"])).alias("is_wet"),
        F.lit(DEFAULT_WEATHER["rain_chance"]).alias("rain_chance"),
    )


def standings_with_circuit(standings: DataFrame, stats: DataFrame) -> DataFrame:
    return standings.join(stats.select("driver_id", *CIRCUIT_STATS), "driver_id", "left")


def standings_with_team(standings: DataFrame, teams: DataFrame) -> DataFrame:
    return standings.join(
        teams.select(
            "constructor_id", "constructor_name", "constructor_points", "constructor_wins"
        ),
        "constructor_id",
        "left",
    )


def race_qualifying_or_grid(
    df: DataFrame, race_qualifying: DataFrame, past: DataFrame
) -> DataFrame:
    """The race's qualifying positions; average past grids if there are none.

    Written before it is asked whether there are any: a race's field is small.
    """
    race_qualifying = materialize(race_qualifying, "race_qualifying")
    if race_qualifying.isEmpty():
        positions = average_grid(past).withColumnRenamed("avg_grid", "qualifying_position")
    else:
        positions = race_qualifying.select(
            "driver_id", F.col("position").cast("double").alias("qualifying_position")
        )
    return df.join(positions, "driver_id", "left")


def first_race_qualifying(qualifying: DataFrame, season: int, circuit_id: str) -> DataFrame:
    """Qualifying of the first race at the circuit that season."""
    rows = at_circuit(qualifying.filter(F.col("season") == season), circuit_id)
    first = rows.filter(F.col("race_date") == rows.agg(F.min("race_date")).scalar())
    return first.groupBy("race_date", "driver_id").agg(F.min("position").alias("position"))


def score_matrix(
    t: Tables,
    past: DataFrame,
    stats: DataFrame,
    season: int,
    circuit_id: str,
    weather: DataFrame,
) -> DataFrame:
    """One row per driver of the coming race: names and the 18 features.

    ``weather`` has the race's one row (defaults included).
    """
    field = standings_with_circuit(t.driver_standings.filter(F.col("season") == season), stats)
    field = standings_with_team(
        field, t.constructor_standings.filter(F.col("season") == season)
    )
    entered = at_circuit(t.entries.filter(F.col("season") == season), circuit_id)
    field = keep_members(field, entered.select("driver_id"), "driver_id", True)
    field = race_qualifying_or_grid(
        field, first_race_qualifying(t.qualifying, season, circuit_id), past
    )
    field = field.join(latest_form(past, t.order), "driver_id", "left")
    # The race's circuit and weather are one row each: looked up once, not joined.
    race = field.sparkSession.createDataFrame([(circuit_id,)], "circuit_id string")
    place = with_circuit_features(race, t.circuit_features).select(
        F.struct("circuit_type_code", "circuit_length")
    )
    day = weather.select(
        F.struct("temperature", F.col("is_wet").cast("int").alias("is_wet"), "rain_chance")
    )
    return field.withColumns({"place": place.scalar(), "day": day.scalar()}).select(
        "driver_id", "driver", "constructor_name", *FEATURES[:13], "place.*", "day.*"
    )


def target_circuit_stats(t: Tables, past_all: DataFrame, past: DataFrame, circuit_id: str):
    """Records at the target circuit: all drivers' races there, or, if it has
    none, the active drivers' races anywhere."""
    return circuit_stats_or_overall(at_circuit(past_all, circuit_id), past)


