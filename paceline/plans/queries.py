"""Every operator as a query over the star tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions import scalars
from paceline.operators import features, filters, kept, metrics, model, stats
from paceline.operators.balance import balance
from paceline.operators.neighbours import nearest, recall
from paceline.operators.split import hash_split
from paceline.operators.windows import history_features
from paceline.plans import derived, jobs, matrices, star
from paceline.plans.tables import Tables
from paceline.schemas import CIRCUIT_STATS, DOCUMENTS, FEATURES, FORM
from paceline.session import materialize, scratch, shared_dir
from paceline.sources import dimensions, sinks
from paceline.sources import documents as docs

QUERIES: dict[str, Callable] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions as double, days as text."""
    casts = {
        T.ByteType: "bigint",
        T.ShortType: "bigint",
        T.IntegerType: "bigint",
        T.FloatType: "double",
        T.DecimalType: "double",
        T.DateType: "string",
    }
    return df.select(
        *[
            F.col(f.name).cast(casts[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in casts
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


def _history(spark, sf) -> DataFrame:
    return matrices.history(star.history_results(spark, sf), star.SEASON)


def _history_table(spark, sf) -> DataFrame:
    """The history as the window operators read it, more than once: written, so
    that the joins behind it run once."""
    columns = ["row_key", *star.ORDER, "driver_id", "constructor_id", "finish", "points", "win"]
    return materialize(_history(spark, sf).select(*columns), "history")


def _past(spark, sf) -> DataFrame:
    return filters.keep_members(_history(spark, sf), star.active_drivers(spark, sf), "driver_id")


def _stats(spark, sf) -> DataFrame:
    return stats.circuit_stats(filters.at_circuit(_history(spark, sf), star.CIRCUIT))


# Sources and scalar functions


@query
def flatten_results(spark, sf):
    return docs.flatten_results(derived.result_documents(spark, sf))


@query
def flatten_schedule(spark, sf):
    return docs.flatten_schedule(derived.schedule_documents(spark, sf))


@query
def flatten_qualifying(spark, sf):
    return docs.flatten_qualifying(derived.qualifying_documents(spark, sf))


@query
def flatten_drivers(spark, sf):
    return docs.flatten_drivers(derived.driver_documents(spark, sf))


@query
def flatten_entries(spark, sf):
    return docs.flatten_entries(derived.entry_documents(spark, sf))


@query
def flatten_driver_standings(spark, sf):
    return docs.flatten_driver_standings(derived.driver_standing_documents(spark, sf))


@query
def flatten_team_standings(spark, sf):
    return docs.flatten_constructor_standings(derived.constructor_standing_documents(spark, sf))


@query
def flatten_weather(spark, sf):
    return docs.flatten_weather(derived.weather_documents(spark, sf))


@query
def json_props(spark, sf):
    props = F.from_json("props", "k bigint")
    return star.read(spark, sf, "events").select("event_id", props["k"].alias("k"))


@query
def quarantine_props(spark, sf):
    """Texts cut short do not parse; they are set aside, the others kept."""
    text = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)"))
    texts = star.read(spark, sf, "events").select("event_id", F.coalesce(text, F.col("props")).alias("text"))
    documents = docs.parse_texts(texts, "text", "k bigint")
    kept = docs.readable(documents, "props", root="k").withColumn("unreadable", F.lit(None).cast("string"))
    aside = docs.quarantine(documents, "props", root="k").withColumn("k", F.lit(None).cast("bigint"))
    return kept.unionByName(aside)


@query
def newest_forecasts(spark, sf):
    """Two-day forecasts made every day, in one place: of those for a day the newest counts."""
    return docs.newest(docs.flatten(derived.overlapping_weather_documents(spark, sf), "weather"), "weather")


def _recaptured(spark, sf) -> DataFrame:
    """Rows of the newest captures of documents that were captured up to three times."""
    documents = docs.parse_texts(derived.recaptured_texts(spark, sf), "value", DOCUMENTS["results"])
    documents = materialize(docs.readable(documents, "results"), "documents")
    return docs.flatten(docs.current(documents, "results"), "results").drop(docs.CAPTURED)


@query
def recaptured_results(spark, sf):
    """A corrected date and drivers who are gone: only what the newest capture says is left."""
    return docs.accepted(_recaptured(spark, sf), "results")


@query
def rejected_results(spark, sf):
    """Rows that lack what they must have, and what that is."""
    rows = docs.rejected(_recaptured(spark, sf), "results")
    return rows.select("season", "round", "race_name", "driver", "finish", "points", F.array_join(docs.REASONS, ", ").alias("reasons"))


@query
def captures_replaced(spark, sf):
    """The captures that a newer one of their request replaces; texts that can't be read replace none."""
    documents = docs.parse_texts(derived.recaptured_texts(spark, sf), "value", DOCUMENTS["results"])
    return docs.superseded(docs.manifest(docs.readable(documents, "results"), "results"), "results")


def _issued(spark, sf) -> DataFrame:
    """Two-day forecasts made every day in one place, all that were ever made."""
    return docs.issued_forecasts(docs.flatten(derived.overlapping_weather_documents(spark, sf), "weather"))


@query
def forecasts_as_of(spark, sf):
    """Forecasts known on a day: later ones change nothing."""
    return jobs.forecasts_as_of(_issued(spark, sf), star.WEATHER_AS_OF)


@query
def forecast_as_of_join(spark, sf):
    """Each race with the forecast that was known on its own as-of day, a day before or on it."""
    races = star.event_calendar(spark, sf).withColumn("country", F.lit("XX"))
    ahead = F.pmod(F.length("race_name"), F.lit(3)).cast("int")
    return jobs.join_forecasts_as_of(races.withColumn("as_of", F.date_sub("race_date", ahead)), _issued(spark, sf), "as_of")


@query
def stats_without_unknown_drivers(spark, sf):
    """Circuit records and average grids where some rows do not say whose they are."""
    named = F.when(F.col("line_no") != 3, F.col("driver_id")).alias("driver_id")
    rows = _history(spark, sf).select(named, "circuit_id", "race_date", "finish", "points", "grid")
    rows = materialize(filters.at_circuit(rows, star.CIRCUIT), "known")
    return stats.circuit_stats(rows).join(stats.average_grid(rows), "driver_id")


@query
def driver_name_concat(spark, sf):
    name = scalars.full_name(F.col("c_mktsegment"), F.col("c_name"))
    return star.read(spark, sf, "customer").select(
        "c_custkey", name.alias("driver"), F.lower(name).alias("driver_lower")
    )


@query
def safe_int_cast(spark, sf):
    rows = star.read(spark, sf, "orders")
    priority = F.split("o_orderpriority", "-")
    return rows.select(
        "o_orderkey",
        scalars.digits_to_int(priority[0]).alias("from_digits"),
        scalars.digits_to_int(priority[1]).alias("from_word"),
        scalars.digits_to_int(F.concat(F.lit("-"), priority[0])).alias("from_negative"),
        scalars.digits_to_int(F.concat(F.lit(" "), priority[0])).alias("from_spaced"),
        scalars.digits_to_int(F.lit("")).alias("from_empty"),
    )


@query
def date_parse_diff(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-M-d")
    day = scalars.parse_day(text)
    return star.read(spark, sf, "orders").select(
        "o_orderkey",
        text.alias("day_text"),
        day.alias("day"),
        scalars.days_until(day, star.AS_OF).alias("days_ahead"),
        F.date_format(day, "yyyy-MM-dd").alias("day_padded"),
    )


# Filters


@query
def season_window(spark, sf):
    rows = filters.last_seasons(star.history_results(spark, sf), star.SEASON)
    return rows.select("row_key", "season", "points")


@query
def circuit_filter(spark, sf):
    rows = filters.at_circuit(_history(spark, sf), star.CIRCUIT)
    return rows.select("row_key", "circuit_id", "points")


@query
def completed_races(spark, sf):
    return filters.completed(star.races(spark, sf, star.SEASON, star.SEASON), star.AS_OF)


@query
def last_n_races(spark, sf):
    held = filters.completed(star.races(spark, sf, star.SEASON, star.SEASON), star.AS_OF)
    return filters.last_n_races(held, 5, ["race_date", "race_id"])


@query
def recent_results(spark, sf):
    schedule = star.races(spark, sf, star.SEASON, star.SEASON).withColumnRenamed("race_id", "round")
    rows = star.season_results(spark, sf).withColumns(
        {"round": F.col("race_id"), "race_name": F.col("row_key")}
    )
    return jobs.recent_results(rows, schedule, star.SEASON, star.AS_OF)


def _all_results(spark, sf) -> DataFrame:
    return star.results(spark, sf).withColumn("win", scalars.win_flag(F.col("finish")))


@query
def win_flag(spark, sf):
    return _all_results(spark, sf).select("row_key", "finish", "win")


@query
def winner_per_season(spark, sf):
    return jobs.past_winners(
        star.history_results(spark, sf),
        star.CIRCUIT,
        star.SEASON,
        ["race_date", "race_id", "finish", *star.ORDER[2:], "driver_id"],
    )


@query
def winner_per_circuit(spark, sf):
    return stats.winners(
        _all_results(spark, sf),
        ["season", "circuit_id"],
        ["race_date", "race_id", "finish", *star.ORDER[2:], "driver_id"],
        ["driver", "constructor_name"],
    )


# Lookups


@query
def alias_lookup_default(spark, sf):
    customer = star.read(spark, sf, "customer").join(
        star.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return dimensions.resolve_circuit(customer, "n_name", star.circuit_aliases(spark, sf)).select(
        "c_custkey", "circuit_id"
    )


@query
def circuit_feature_lookup(spark, sf):
    return dimensions.with_circuit_features(
        _all_results(spark, sf).select("row_key", "circuit_id"), star.circuit_features(spark, sf)
    )


# Windows


@query
def driver_totals_before(spark, sf):
    rows = history_features(
        _history_table(spark, sf), ["driver_id"], star.ORDER, matrices.DRIVER_TOTALS
    )
    return rows.select("row_key", "driver_id", *matrices.DRIVER_TOTALS)


@query
def team_totals_before_faithful(spark, sf):
    rows = matrices.with_team_totals(_history_table(spark, sf), star.ORDER, "faithful")
    return rows.select("row_key", "constructor_id", *matrices.TEAM_TOTALS)


@query
def team_totals_before_asof(spark, sf):
    rows = matrices.with_team_totals(_history_table(spark, sf), star.ORDER, "corrected")
    return rows.select("row_key", "constructor_id", *matrices.TEAM_TOTALS)


@query
def form_last5(spark, sf):
    rows = matrices.with_form(_history_table(spark, sf), star.ORDER, "corrected")
    return rows.select("row_key", "driver_id", *FORM)


@query
def form_last5_faithful(spark, sf):
    rows = matrices.with_form(_history_table(spark, sf), star.ORDER, "faithful")
    return rows.select("row_key", "driver_id", *FORM)


@query
def driver_history(spark, sf):
    """Totals and form of a driver together: one pass over the segments."""
    rows = history_features(
        _history_table(spark, sf), ["driver_id"], star.ORDER, matrices.DRIVER_TOTALS, matrices.FORM_COLUMNS
    )
    return rows.select("row_key", *matrices.DRIVER_TOTALS, *FORM)


def _rounds(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The history until the last season, and that in two rounds that share a day."""
    rows = _history_table(spark, sf).withColumn("season", F.year("race_date"))
    last = star.SEASON - 1
    cut = F.col("race_date") < F.lit(f"{last}-06-15").cast("date")
    # Half of the border day's races come with the first round.
    early = cut | (F.col("race_date") == F.lit(f"{last}-06-15").cast("date")) & (F.col("race_id") % 2 == 0)
    new = rows.filter(F.col("season") == last)
    return rows.filter(F.col("season") < last), new.filter(early), new.filter(~early)


def _kept(spark, state: DataFrame) -> DataFrame:
    """A state, published and read back."""
    path = _sink(spark)
    sinks.publish({"state": state}, path)
    return sinks.published(spark, path, "state", state.schema)


@query
def kept_driver_history(spark, sf):
    """A season's totals and form from the state before it, advanced by two rounds."""
    old, *rounds = _rounds(spark, sf)
    # Rounds must follow each other in order, so the second begins with a new day.
    day = F.col("race_date") <= F.lit(f"{star.SEASON - 1}-06-15").cast("date")
    new = rounds[0].unionByName(rounds[1])
    args = (["driver_id"], star.ORDER, matrices.DRIVER_TOTALS, matrices.FORM_COLUMNS)
    state, out = _kept(spark, kept.fold(old, *args)), None
    for rows in (new.filter(day), new.filter(~day)):
        done, state = kept.advance(state, rows, *args)
        state = _kept(spark, state)
        out = done if out is None else out.unionByName(done)
    return out.select("row_key", *matrices.DRIVER_TOTALS, *FORM)


@query
def kept_team_totals(spark, sf):
    """A season's team totals from the state before it, advanced by two rounds that share a day."""
    old, *rounds = _rounds(spark, sf)
    args = (["constructor_id"], "race_date", matrices.TEAM_TOTALS)
    state, out = _kept(spark, kept.fold_as_of(old, *args)), None
    for rows in rounds:
        done, state = kept.advance_as_of(state, rows, *args)
        state = _kept(spark, state)
        out = done if out is None else out.unionByName(done)
    # What the shared day's second half adds is seen by later days alone, in either round.
    return out.select("row_key", *matrices.TEAM_TOTALS)


# Statistics


@query
def circuit_stats(spark, sf):
    return _stats(spark, sf)


@query
def circuit_stats_fallback(spark, sf):
    return stats.circuit_stats_or_overall(
        filters.at_circuit(_history(spark, sf), "NATION_99"), _past(spark, sf)
    )


@query
def circuit_stats_asof(spark, sf):
    return stats.circuit_stats_as_of(_history(spark, sf)).select("row_key", *CIRCUIT_STATS)


@query
def avg_grid(spark, sf):
    return stats.average_grid(_past(spark, sf))


@query
def driver_standings(spark, sf):
    return star.driver_standings(spark, sf)


@query
def recent_performance(spark, sf):
    return jobs.recent_performance(star.driver_standings(spark, sf), star.SEASON)


@query
def team_standings(spark, sf):
    return star.constructor_standings(spark, sf)


@query
def standings_all_seasons(spark, sf):
    return stats.standings(star.results(spark, sf), ["season", "driver_id"])


@query
def last_race_day(spark, sf):
    return star.results(spark, sf).agg(F.max("race_date").alias("last_day"))


# Joins and branches


@query
def active_driver_semi(spark, sf):
    return _past(spark, sf).select("row_key", "driver_id")


def _entered(spark, sf, circuit):
    rows = materialize(star.season_results(spark, sf), "results")
    entered = filters.at_circuit(star.entries_of(rows), circuit)
    return filters.keep_members(star.driver_standings_of(rows), entered, "driver_id", True)


@query
def entry_list_semi(spark, sf):
    return _entered(spark, sf, star.CIRCUIT)


@query
def entry_list_semi_empty(spark, sf):
    return _entered(spark, sf, "NATION_99")


@query
def standings_circuit_left(spark, sf):
    return matrices.standings_with_circuit(star.driver_standings(spark, sf), _stats(spark, sf))


@query
def standings_team_left(spark, sf):
    return matrices.standings_with_team(
        star.driver_standings(spark, sf), star.constructor_standings(spark, sf)
    )


def _race_qualifying(rows, circuit):
    return matrices.first_race_qualifying(star.qualifying_of(rows), star.SEASON, circuit)


@query
def race_qualifying(spark, sf):
    rows = materialize(star.season_results(spark, sf), "results")
    return _race_qualifying(rows, star.CIRCUIT).select("race_date", "driver_id", "position")


def _history_of(spark, sf, rows) -> DataFrame:
    """The history of active drivers out of written results."""
    past = matrices.history(rows, star.SEASON)
    return filters.keep_members(past, star.active_drivers(spark, sf), "driver_id")


def _qualified(spark, sf, circuit):
    rows = star.written_results(spark, sf)
    return matrices.race_qualifying_or_grid(
        star.driver_standings_of(rows), _race_qualifying(rows, circuit), _history_of(spark, sf, rows)
    )


@query
def qualifying_left(spark, sf):
    return _qualified(spark, sf, star.CIRCUIT)


@query
def qualifying_fallback(spark, sf):
    return _qualified(spark, sf, "NATION_99")


def _history_qualified(spark, sf, first, last):
    rows = star.written_results(spark, sf)
    known = star.in_seasons(star.qualifying_of(rows), first, last)
    return matrices.with_qualifying(_history_of(spark, sf, rows), known).select(
        "row_key", "grid", "qualifying_position"
    )


@query
def history_qualifying_left(spark, sf):
    return _history_qualified(spark, sf, star.SEASON - 3, star.SEASON - 1)


@query
def history_qualifying_fallback(spark, sf):
    return _history_qualified(spark, sf, star.SEASON + 5, star.SEASON + 5)


@query
def latest_snapshot(spark, sf):
    rows = matrices.with_form(_history_table(spark, sf), star.ORDER, "corrected")
    past = filters.keep_members(rows, star.active_drivers(spark, sf), "driver_id")
    return matrices.latest_form(materialize(past, "past"), star.ORDER)


@query
def history_circuit_left(spark, sf):
    return matrices.standings_with_circuit(_past(spark, sf), _stats(spark, sf)).select(
        "row_key", *CIRCUIT_STATS
    )


@query
def union_seasons(spark, sf):
    """Consecutive seasons are one range of the scan, not a scan each."""
    return star.races(spark, sf, star.SEASON - 3, star.SEASON - 1)


# Weather and calendar


@query
def weather_default_join(spark, sf):
    return jobs.weather_or_default(
        star.event_calendar(spark, sf), star.daily_weather(spark, sf), star.WEATHER_AS_OF
    ).withColumn("is_wet", F.col("is_wet").cast("int"))


@query
def track_condition(spark, sf):
    wet = F.col("event_type") == "error"
    return star.read(spark, sf, "events").select(
        "event_id",
        F.col("value").alias("track_temperature"),
        wet.cast("int").alias("is_wet"),
        scalars.track_condition(F.col("value"), wet).alias("track_condition"),
    )


@query
def forecast_horizon(spark, sf):
    rows = star.read(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return filters.within_days(rows, "day", star.WEATHER_AS_OF, jobs.LONG_HORIZON)


@query
def upcoming_races(spark, sf):
    return jobs.upcoming_races(star.event_calendar(spark, sf), star.WEATHER_AS_OF)


def _forecast_columns(df):
    return df.withColumn("is_wet", F.col("is_wet").cast("int"))


@query
def race_day_forecast(spark, sf):
    known = star.read(spark, sf, "nation").select(F.lower("n_name").alias("race_name"))
    unknown = star.read(spark, sf, "region").select(F.lower("r_name").alias("race_name"))
    asked = known.unionByName(unknown).withColumn("season", F.lit(star.SEASON))
    return _forecast_columns(
        jobs.race_day_forecast(
            asked,
            star.event_calendar(spark, sf),
            star.daily_weather(spark, sf),
            star.WEATHER_AS_OF,
        )
    )


@query
def upcoming_forecasts(spark, sf):
    return _forecast_columns(
        jobs.upcoming_forecasts(
            star.event_calendar(spark, sf), star.daily_weather(spark, sf), star.WEATHER_AS_OF
        )
    )


def _sessions(spark, sf, rows) -> tuple[DataFrame, DataFrame]:
    """The season's events, and the results of their sessions."""
    events = star.races(spark, sf, star.SEASON, star.SEASON).select(
        "season",
        F.col("race_id").alias("round"),
        F.col("circuit_id").alias("track_name"),
        "race_date",
    )
    sessions = rows.select(
        "season",
        F.col("race_id").alias("round"),
        F.col("driver_id").cast("string").alias("driver_number"),
        F.col("finish").cast("double").alias("position"),
        F.col("points").cast("double").alias("points"),
    )
    return events, sessions


@query
def season_so_far(spark, sf):
    events, sessions = _sessions(spark, sf, star.season_results(spark, sf))
    return jobs.season_so_far(events, sessions, star.SEASON, star.AS_OF)


# Feature matrices


def _train(spark, sf, variant="faithful", only="train"):
    t = star.tables(spark, sf)
    return jobs.prepare(t, star.CIRCUIT, star.SEASON, variant=variant, only=only).train()


@query
def train_matrix(spark, sf):
    return _train(spark, sf)


@query
def train_matrix_corrected(spark, sf):
    return _train(spark, sf, "corrected")


@query
def score_matrix(spark, sf):
    t = star.tables(spark, sf)
    race = t.calendar.filter(F.col("race_name") == star.RACE_NAME)
    weather = jobs.weather_or_default(race, t.weather, star.WEATHER_AS_OF)
    return jobs.prepare(t, star.CIRCUIT, star.SEASON, only="score").score(weather)


@query
def fill_and_clean(spark, sf):
    """Values made NULL, NaN and infinite by turns, then cleaned."""
    turn = F.col("event_id") % 5
    made = (
        F.when(turn == 0, F.lit(None).cast("double"))
        .when(turn == 1, F.lit(float("nan")))
        .when(turn == 2, F.lit(float("inf")))
        .when(turn == 3, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    rows = star.read(spark, sf, "events").select("event_id", made.alias("value"))
    return features.clean(rows, ["value"], flag_missing=True)


@query
def log_and_weight(spark, sf):
    rows = features.weight(features.clean(_train(spark, sf)))
    return rows.select("row_key", *[F.round(c, 9).alias(c) for c in features.WEIGHTS])


def _scaled(spark, sf):
    # With its steps written and deleted again, so that their shuffles do not lie there all at once.
    with scratch(spark):
        train = materialize(features.weight(features.clean(_train(spark, sf, only=None))), "train", keep=True)
    return features.robust_apply(train, features.robust_fit(train))


@query
def robust_parameters(spark, sf):
    train = materialize(features.weight(features.clean(_train(spark, sf))), "train")
    return features.robust_fit(train).select(
        "feature", F.round("center", 9).alias("center"), F.round("scale", 9).alias("scale")
    )


@query
def robust_scale(spark, sf):
    return _scaled(spark, sf).select(
        "row_key", "label", *[F.round(c, 9).alias(c) for c in FEATURES]
    )


# Balancing, splitting, scoring


@query
def hash_split_rows(spark, sf):
    rows = materialize(_all_results(spark, sf).select("row_key", "win"), "results")
    return hash_split(rows, "row_key").withColumn("is_test", F.col("is_test").cast("int"))


@query
def vector_neighbours(spark, sf):
    found = nearest(star.read(spark, sf, "embeddings"), "vec_id", "embedding")
    return found.select("id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


@query
def projected_neighbours_recall(spark, sf):
    """What the search by projections finds of the exact neighbours."""
    rows = star.read(spark, sf, "embeddings")
    exact = nearest(rows, "vec_id", "embedding")
    return recall(nearest(rows, "vec_id", "embedding", method="projected"), exact)


def _minority_labels(spark, sf):
    """Vectors, labelled 1 in the class with the fewest (the first of equals)."""
    rows = star.read(spark, sf, "embeddings")
    smallest = rows.groupBy("label").count().orderBy("count", "label").limit(1)
    return rows.select(
        F.col("vec_id").cast("string").alias("row_key"),
        F.col("embedding").cast("array<double>").alias("vec"),
        (F.col("label") == smallest.select("label").scalar()).cast("int").alias("label"),
    )


@query
def smote_balance(spark, sf):
    rows = balance(_minority_labels(spark, sf))
    return rows.select(
        "row_key",
        "label",
        F.col("synthetic").cast("int").alias("synthetic"),
        F.posexplode("vec").alias("pos", "value"),
    ).withColumn("value", F.round("value", 6))


@query
def smote_counts(spark, sf):
    """Rows per class after balancing the training matrix."""
    rows = balance(features.assemble(_scaled(spark, sf)))
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.col("synthetic").cast("int")).alias("synthetic_n")
    )


@query
def accuracy(spark, sf):
    return metrics.accuracy(star.read(spark, sf, "labels"), "quality", "toxic")


@query
def class_report(spark, sf):
    return metrics.class_report(star.read(spark, sf, "labels"), "quality", "toxic")


def rank_rates(spark, sf):
    rates = _stats(spark, sf).withColumn(
        "win_probability", F.coalesce("win_rate_circuit", F.lit(0.0)) * 100
    )
    return model.rank_by_probability(rates, ["driver_id", "win_probability"])


@query
def rank_desc(spark, sf):
    return rank_rates(spark, sf)


@lru_cache(maxsize=4)  # keeps a model and plans, not rows
def _prediction(spark, sf) -> jobs.Prediction:
    return jobs.predict_winner(
        lambda: star.tables(spark, sf), star.RACE_NAME, star.SEASON, star.WEATHER_AS_OF
    )


@query
def predict_winner(spark, sf):
    return _prediction(spark, sf).ranking


@query
def feature_importance(spark, sf):
    return _prediction(spark, sf).importances


@query
def ranked_field(spark, sf):
    """Who is ranked: every driver of the standings who is entered at the circuit."""
    return _prediction(spark, sf).ranking.select("driver", "constructor_name")


@query
def prediction_checks(spark, sf):
    """What must hold of a trained model, as named flags."""
    p = _prediction(spark, sf)
    chance = F.col("win_probability")
    outside = p.ranking.filter(~chance.between(0, 100)).count()
    order = [r[0] for r in p.ranking.select("win_probability").collect()]
    total = p.importances.agg(F.round(F.sum("importance"), 6)).first()[0]
    majority = p.learnt_from.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    few = model.TreeSettings(trees=3)
    rows = p.learnt_from
    one, other = (model.fit(rows.repartition(n), few).toDebugString for n in (2, 5))
    flags = {
        "probabilities_in_range": outside == 0,
        "descending": order == sorted(order, reverse=True),
        "importances_named": sorted(r[0] for r in p.importances.collect()) == sorted(FEATURES),
        "importances_sum_to_one": total == 1.0,
        "better_than_majority": p.accuracy.first()["accuracy"] >= majority,
        "same_trees_whatever_the_partitions": one.split("\n", 1)[1] == other.split("\n", 1)[1],
    }
    return spark.createDataFrame([(k, int(v)) for k, v in flags.items()], "name string, holds int")


# Sinks: written to the shared folder and read back


def _sink(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/paceline/{spark.sparkContext.applicationId}/sinks-{uuid.uuid4().hex}"


@query
def sink_ranking(spark, sf):
    rates = rank_rates(spark, sf)
    path = _sink(spark)
    sinks.write_ranking(rates, path)
    return sinks.published(spark, path, "ranking", rates.schema)


@query
def sink_season_page(spark, sf):
    """The season page's driver and team tables as JSON, back in one table."""
    rows = materialize(star.season_results(spark, sf), "results")
    tables = {"driver_standings": star.driver_standings_of(rows), "constructor_standings": star.constructor_standings_of(rows)}
    path = _sink(spark)
    sinks.write_season_tables(tables, path)
    drivers, teams = (sinks.published(spark, path, n, t.schema) for n, t in tables.items())
    return drivers.select(F.lit("driver").alias("kind"), F.col("driver").alias("name"), "points", "wins").unionByName(
        teams.select(
            F.lit("team").alias("kind"),
            F.col("constructor_name").alias("name"),
            F.col("constructor_points").alias("points"),
            F.col("constructor_wins").alias("wins"),
        )
    )


@query
def sink_report(spark, sf):
    labels = star.read(spark, sf, "labels")
    report = metrics.class_report(labels, "quality", "toxic")
    path = _sink(spark)
    sinks.write_model_report({"class_report": report, "accuracy": metrics.accuracy(labels, "quality", "toxic")}, path)
    return sinks.published(spark, path, "class_report", report.schema)


@query
def sink_season_tables(spark, sf):
    """All four tables of the season page, published together as JSON, back in one table."""
    rows = materialize(star.season_results(spark, sf), "results")
    t = Tables(
        results=rows, qualifying=None, drivers=None, entries=None, weather=None, circuit_aliases=None, circuit_features=None,
        driver_standings=star.driver_standings_of(rows), constructor_standings=star.constructor_standings_of(rows),
        calendar=star.event_calendar(spark, sf),
    )
    events, sessions = _sessions(spark, sf, rows)
    tables = jobs.season_tables(t, events, sessions, star.SEASON, star.AS_OF)
    tables["upcoming_races"] = jobs.upcoming_races(t.calendar, star.WEATHER_AS_OF)
    path = _sink(spark)
    sinks.write_season_tables(tables, path)
    shapes = {
        "current_season": ("track_name", "points"), "driver_standings": ("driver", "points"),
        "constructor_standings": ("constructor_name", "constructor_points"), "upcoming_races": ("race_name", None),
    }
    out = None
    for kind, (name, number) in shapes.items():
        back = sinks.published(spark, path, kind, tables[kind].schema)
        number = F.col(number) if number else F.lit(None)
        part = back.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), number.cast("double").alias("points"))
        out = part if out is None else out.unionByName(part)
    return out
