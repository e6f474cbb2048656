"""The questions a user asks, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.scalars import (
    DEFAULT_WEATHER,
    days_until,
    track_condition,
)
from paceline.operators import metrics, model
from paceline.operators.balance import balance
from paceline.operators.features import assemble, clean, robust_apply, robust_fit, weight
from paceline.operators.filters import (
    at_circuit,
    completed,
    keep_members,
    last_n_races,
    last_seasons,
    within_days,
)
from paceline.operators.split import hash_split
from paceline.operators.stats import circuit_stats_as_of, winners
from paceline.plans.matrices import (
    history,
    score_matrix,
    target_circuit_stats,
    train_matrix,
    with_history_columns,
)
from paceline.plans.tables import Tables
from paceline.schemas import FEATURES, FORM
from paceline.session import materialize, scratch
from paceline.sources.dimensions import resolve_circuit

# How many days ahead a forecast reaches.
LONG_HORIZON, SHORT_HORIZON = 14, 3


def forecasts_as_of(weather: DataFrame, as_of_date: str) -> DataFrame:
    """What was known on a day: of the forecasts made by then the last for each place and day.

    A table without ``issued`` has one forecast for each, known all along.
    """
    if "issued" not in weather.columns:
        return weather
    keys = ["city", "country", "forecast_date"]
    rest = [c for c in weather.columns if c not in (*keys, "issued")]
    made = weather.filter(F.col("issued") <= F.lit(as_of_date).cast("date"))
    best = made.groupBy(*keys).agg(F.max(F.struct("issued", *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def join_forecasts_as_of(races: DataFrame, weather: DataFrame, as_of: str) -> DataFrame:
    """``races`` (city, country, race_date and a day ``as_of``), each with its day's last forecast
    made by its own as-of day: ``issued`` and the forecast, null where none was made.

    An equality join on place and day; a day has no more forecasts than were made for it,
    and one is kept for each as-of day before races meet them.
    """
    keys = ["city", "country", "race_date", as_of]
    made = weather.withColumnRenamed("forecast_date", "race_date")
    rest = [c for c in made.columns if c not in ("city", "country", "race_date", "issued")]
    asked = races.select(*keys).distinct()
    known = asked.join(made, ["city", "country", "race_date"]).filter(F.col("issued") <= F.col(as_of))
    best = known.groupBy(*keys).agg(F.max(F.struct("issued", *rest)).alias("best"))
    best = best.select(*keys, "best.issued", *(F.col(f"best.{c}").alias(c) for c in rest))
    return races.join(best, keys, "left")


def weather_or_default(
    races: DataFrame, weather: DataFrame, as_of_date: str, horizon: int = LONG_HORIZON
) -> DataFrame:
    """Races with their day's forecast known on ``as_of_date``; defaults out of reach or where none is."""
    reachable = within_days(forecasts_as_of(weather, as_of_date), "forecast_date", as_of_date, horizon).withColumnRenamed(
        "forecast_date", "race_date"
    )
    joined = races.join(reachable, ["city", "country", "race_date"], "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in DEFAULT_WEATHER.items()}
    )


def race_day_forecast(
    asked: DataFrame, calendar: DataFrame, weather: DataFrame, as_of_date: str
) -> DataFrame:
    """Track conditions for each asked-for race, or why there are none.

    ``asked`` has (season, race_name).  ``status`` says "ok", "unknown race",
    "out of reach" (not 0 to 3 days ahead) or "no forecast".
    """
    reachable = within_days(
        forecasts_as_of(weather, as_of_date), "forecast_date", as_of_date, SHORT_HORIZON
    ).withColumnRenamed("forecast_date", "race_date")
    ahead = days_until(F.col("race_date"), as_of_date)
    rows = (
        asked.select("season", "race_name")
        .join(calendar, ["season", "race_name"], "left")
        .join(reachable, ["city", "country", "race_date"], "left")
    )
    condition = track_condition(F.col("temperature"), F.col("is_wet"))
    status = (
        F.when(F.col("race_date").isNull(), "unknown race")
        .when(~ahead.between(0, SHORT_HORIZON), "out of reach")
        .when(F.col("temperature").isNull(), "no forecast")
        .otherwise("ok")
    )
    return rows.select(
        "season",
        "race_name",
        "race_date",
        status.alias("status"),
        F.col("temperature").alias("track_temperature"),
        "is_wet",
        F.when(F.col("temperature").isNotNull(), condition).alias("track_condition"),
        "rain_chance",
    )


def upcoming_races(calendar: DataFrame, as_of_date: str, horizon: int = SHORT_HORIZON) -> DataFrame:
    return within_days(calendar, "race_date", as_of_date, horizon)


def upcoming_forecasts(calendar: DataFrame, weather: DataFrame, as_of_date: str) -> DataFrame:
    """Forecasts for every race of the next three days, in one query."""
    return race_day_forecast(
        upcoming_races(calendar, as_of_date), calendar, weather, as_of_date
    )


def past_winners(
    results: DataFrame, circuit_id: str, as_of_season: int, order: list[str], n: int = 3
) -> DataFrame:
    """Winner of the first race at the circuit in each of the last seasons."""
    rows = at_circuit(last_seasons(results, as_of_season, n), circuit_id)
    return winners(rows, ["season"], order, ["driver", "constructor_name"])


def past_winners_at(t: Tables, track_name: str, as_of_season: int, n: int = 3) -> DataFrame:
    """As ``past_winners``, for a circuit given by any of its names."""
    return past_winners(
        t.results,
        circuit_of(t, track_name),
        as_of_season,
        [t.order[0], *t.order[1:2], "finish", *t.order[2:]],
        n,
    )


def circuit_of(t: Tables, name: str) -> str:
    """The circuit id one name stands for."""
    asked = t.circuit_aliases.sparkSession.createDataFrame([(name,)], "name string")
    return resolve_circuit(asked, "name", t.circuit_aliases).first()["circuit_id"]


def season_so_far(
    events: DataFrame, session_results: DataFrame, season: int, as_of_date: str
) -> DataFrame:
    """Every result of the season's events held by ``as_of_date``."""
    held = completed(events.filter(F.col("season") == season), as_of_date)
    return session_results.join(
        held.select("season", "round", "track_name"), ["season", "round"]
    ).select("driver_number", "position", "points", "round", "track_name")


def recent_results(
    results: DataFrame, schedule: DataFrame, season: int, as_of_date: str, n: int = 5
) -> DataFrame:
    """Results of the season's last ``n`` completed races."""
    held = completed(schedule.filter(F.col("season") == season), as_of_date)
    last = last_n_races(held, n, ["race_date", "round"])
    return results.join(last.select("season", "round"), ["season", "round"], "left_semi").select(
        "race_name", "driver_id", "constructor_id", "points", "finish"
    )


def recent_performance(driver_standings: DataFrame, season: int) -> DataFrame:
    """The season's standings as they are."""
    return driver_standings.filter(F.col("season") == season)


def season_tables(t: Tables, events, session_results, season: int, as_of_date: str) -> dict:
    """The four tables a season page shows."""
    return {
        "current_season": season_so_far(events, session_results, season, as_of_date),
        "driver_standings": t.driver_standings.filter(F.col("season") == season),
        "constructor_standings": t.constructor_standings.filter(F.col("season") == season),
        "upcoming_races": upcoming_races(t.calendar, as_of_date),
    }


@dataclass
class Prepared:
    """What training and scoring both start from."""

    tables: Tables
    past: DataFrame  # results of active drivers with their history columns
    stats: DataFrame  # records at the target circuit
    circuit_id: str
    season: int
    variant: str

    def train(self) -> DataFrame:
        """Training matrix, before cleaning."""
        t = self.tables
        stats = self.stats if self.variant == "faithful" else None
        return train_matrix(self.past, stats, t.qualifying, t.circuit_features, t.key)

    def score(self, weather: DataFrame) -> DataFrame:
        """Scoring matrix, before cleaning; ``weather`` has the race's one row."""
        return score_matrix(
            self.tables, self.past, self.stats, self.season, self.circuit_id, weather
        )


@dataclass
class Prediction:
    ranking: DataFrame
    accuracy: DataFrame
    class_report: DataFrame
    importances: DataFrame
    learnt_from: DataFrame


def prepare(
    t: Tables,
    circuit_id: str,
    season: int,
    as_of_season: int | None = None,
    variant: str = "faithful",
    only: str | None = None,
) -> Prepared:
    """``only`` "train" or "score" says that the result serves for one of them, so that
    nothing is written for the other."""
    as_of_season = season if as_of_season is None else as_of_season
    columns = [*(t.key or ["row_key"]), *t.order, "circuit_id", "driver_id", "constructor_id"]
    columns += ["grid", "finish", "points", "win"]
    past_all = history(t.results, as_of_season).select(*dict.fromkeys(columns))
    if not t.written:
        # Read by every step below; behind it lie the parsing and joins of the sources.
        past_all = materialize(past_all, "history")

    def rows() -> DataFrame:
        windowed = with_history_columns(past_all, t.order, variant)
        if variant == "corrected":
            windowed = circuit_stats_as_of(windowed)
        active = t.drivers.filter(F.col("season") == season)
        past = keep_members(windowed, active, "driver_id")
        if only == "score":
            past = past.select(*dict.fromkeys(["driver_id", *t.order, "grid", "finish", "points", *FORM]))
        return past

    if only == "train":
        past = rows()
        return Prepared(t, past, target_circuit_stats(t, past_all, past, circuit_id), circuit_id, season, variant)
    with scratch(SparkSession.active()):
        # Read for training rows, circuit records, average grids and last form; what the
        # windows shuffle is gone before the joins shuffle theirs.
        past = materialize(rows(), "past", keep=True)
    # Written, so that its size is known: where it is small the rows stay where they are.
    stats = materialize(target_circuit_stats(t, past_all, past, circuit_id), "stats")
    return Prepared(t, past, stats, circuit_id, season, variant)


def predict_winner(
    t: Tables | Callable[[], Tables],
    race_name: str,
    season: int,
    as_of_date: str,
    as_of_season: int | None = None,
    variant: str = "faithful",
    settings: model.TreeSettings = model.TreeSettings(),
) -> Prediction | None:
    """Drivers ranked by how likely they are to win a race.

    None if the calendar does not know the race or there is no history.
    Faithful scales and balances before splitting, as the original does;
    corrected splits first, learns scale and synthetic rows from the training
    part alone, and tells the model which values were missing.  What is written on
    the way is deleted as soon as both matrices are there; so is what ``t`` writes, if
    it is a function that makes the tables.
    """
    with scratch(SparkSession.active()):
        t = t() if callable(t) else t
        race = t.calendar.filter((F.col("race_name") == race_name) & (F.col("season") == season))
        as_of_season = season if as_of_season is None else as_of_season
        if race.isEmpty() or last_seasons(t.results, as_of_season).isEmpty():
            return None
        prepared = prepare(t, circuit_of(t, race_name), season, as_of_season, variant)
        corrected = variant == "corrected"
        train = materialize(weight(clean(prepared.train(), flag_missing=corrected)), "train", keep=True)
        score = weight(clean(prepared.score(weather_or_default(race, t.weather, as_of_date)), flag_missing=corrected))
        score = materialize(score, "score", keep=True)
    inputs = FEATURES + [f"{c}_is_missing" for c in FEATURES] if corrected else FEATURES
    # Balanced rows are made from the originals and the written ways between them wherever they
    # are read, and told apart by a hash and a cut-off: written, they would be several times as large.
    if corrected:
        train = hash_split(train, "row_key")
        fitted = robust_fit(train.filter(~F.col("is_test")))
        scaled = assemble(robust_apply(train, fitted), inputs)
        learn = balance(scaled.filter(~F.col("is_test")))
        test = scaled.filter(F.col("is_test"))
    else:
        fitted = robust_fit(train)
        scaled = assemble(robust_apply(train, fitted))
        split = hash_split(balance(scaled), "row_key")
        learn, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))

    classifier = model.fit(learn, settings)
    tested = model.score(classifier, test)
    ranked = materialize(model.score(classifier, assemble(robust_apply(score, fitted), inputs)), "ranked", keep=True)
    return Prediction(
        ranking=model.rank_by_probability(
            ranked, ["driver", "constructor_name", "win_probability"]
        ),
        accuracy=metrics.accuracy(tested),
        class_report=metrics.class_report(tested),
        importances=model.importances(learn.sparkSession, classifier, inputs),
        learnt_from=learn,
    )
