"""The season model mapped onto a TPC-H-like star schema.

driver = supplier, team = the supplier's nation, race = order, circuit = the
customer's nation, points = quantity.  A retired ('R') line has no finish and an
untaxed one no grid, so that missing values occur.  See FIXTURES.md.
"""

from __future__ import annotations

from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.stats import standings
from paceline.plans.tables import Tables, row_key
from paceline.session import materialize

SEASON = 2001  # the season analysed; its history is 1998 to 2000
AS_OF = "2001-02-01"
CIRCUIT = "NATION_7"
RACE_NAME = "nation_7"
ORDER = ["race_date", "race_id", "line_no", "part_id", "price_cents", "ship_date"]
KEY = ["race_id", "driver_id", "line_no", "part_id", "price_cents", "ship_date"]
WEATHER_AS_OF = "2024-01-05"


# Stated rather than inferred, so that naming a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark, sf_dir, first: int | None = None, last: int | None = None) -> DataFrame:
    """Orders of whole seasons; the range is on the raw column, so it is pushed
    down to the scan."""
    rows = read(spark, sf_dir, "orders")
    if first is not None:
        rows = rows.filter(F.col("o_orderdate") >= F.lit(date(first, 1, 1)).cast("timestamp_ntz"))
    if last is not None:
        rows = rows.filter(F.col("o_orderdate") < F.lit(date(last + 1, 1, 1)).cast("timestamp_ntz"))
    return rows.select(
        F.col("o_orderkey").alias("race_id"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").cast("date").alias("race_date"),
        F.year("o_orderdate").alias("season"),
    )


@lru_cache(maxsize=64)  # keeps plans, not rows
def races(spark, sf_dir, first: int | None = None, last: int | None = None) -> DataFrame:
    """The schedule: one row per race with its circuit."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("circuit_id")
    )
    return (
        orders(spark, sf_dir, first, last)
        .join(customer, "c_custkey")
        .join(nation, "c_nationkey")
        .select("season", "race_id", "race_date", "circuit_id")
    )


@lru_cache(maxsize=64)
def drivers(spark, sf_dir) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("constructor_id"), F.col("n_name").alias("constructor_name")
    )
    return (
        read(spark, sf_dir, "supplier")
        .select(
            F.col("s_suppkey").alias("driver_id"),
            F.col("s_name").alias("driver"),
            F.col("s_nationkey").alias("constructor_id"),
            "s_acctbal",
        )
        .join(nation, "constructor_id")
    )


def lines(spark, sf_dir) -> DataFrame:
    """One row per driver in a race, as far as the line itself tells."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_suppkey").alias("driver_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.when(F.col("l_tax") != 0, (F.col("l_partkey") % 20 + 1).cast("int")).alias("grid"),
        F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("finish"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("int").alias("points"),
    )


@lru_cache(maxsize=64)
def results(spark, sf_dir, first: int | None = None, last: int | None = None) -> DataFrame:
    rows = (
        lines(spark, sf_dir)
        .join(races(spark, sf_dir, first, last), "race_id")
        .join(drivers(spark, sf_dir).drop("s_acctbal"), "driver_id")
    )
    return rows.withColumn("row_key", row_key(KEY))


def history_results(spark, sf_dir) -> DataFrame:
    return results(spark, sf_dir, SEASON - 3, SEASON - 1)


def season_results(spark, sf_dir) -> DataFrame:
    return results(spark, sf_dir, SEASON, SEASON)


def active_drivers(spark, sf_dir) -> DataFrame:
    return (
        read(spark, sf_dir, "supplier")
        .filter("s_acctbal > 0")
        .select(
            F.lit(SEASON).alias("season"),
            F.col("s_suppkey").alias("driver_id"),
            F.col("s_name").alias("driver"),
        )
    )


def in_seasons(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.filter(F.col("season").between(first, last))


def qualifying_of(rows: DataFrame) -> DataFrame:
    """Finished lines of results as qualifying positions; a driver's lowest of a day counts."""
    return rows.filter(F.col("status") == "F").select(
        "season", "circuit_id", "race_date", "driver_id", F.col("line_no").alias("position")
    )


def driver_standings_of(rows: DataFrame) -> DataFrame:
    keys = ["season", "driver_id", "driver", "constructor_id"]
    return standings(in_seasons(rows, SEASON, SEASON), keys)


def constructor_standings_of(rows: DataFrame) -> DataFrame:
    keys = ["season", "constructor_id", "constructor_name"]
    return (
        standings(in_seasons(rows, SEASON, SEASON), keys)
        .withColumnRenamed("points", "constructor_points")
        .withColumnRenamed("wins", "constructor_wins")
    )


def entries_of(rows: DataFrame) -> DataFrame:
    """Who drove where; a driver is listed as often as there are results."""
    return in_seasons(rows, SEASON, SEASON).select("season", "circuit_id", "driver_id")


def qualifying(spark, sf_dir, first: int | None = None, last: int | None = None) -> DataFrame:
    return qualifying_of(results(spark, sf_dir, first, last))


def driver_standings(spark, sf_dir) -> DataFrame:
    return driver_standings_of(season_results(spark, sf_dir))


def constructor_standings(spark, sf_dir) -> DataFrame:
    return constructor_standings_of(season_results(spark, sf_dir))


def entries(spark, sf_dir) -> DataFrame:
    return entries_of(season_results(spark, sf_dir))


def written_results(spark, sf_dir) -> DataFrame:
    """The season's and the history's results, joined once and written: what
    standings, entries, qualifying and history of one job are made from."""
    rows = materialize(results(spark, sf_dir, SEASON - 3, SEASON).drop("row_key"), "results")
    return rows.withColumn("row_key", row_key(KEY))


def _nation(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation")


def circuit_aliases(spark, sf_dir) -> DataFrame:
    """Names of the first 20 nations; the others take the default."""
    return (
        _nation(spark, sf_dir)
        .filter("n_nationkey < 20")
        .select(F.lower("n_name").alias("alias"), F.col("n_name").alias("circuit_id"))
    )


def circuit_features(spark, sf_dir) -> DataFrame:
    street = F.col("n_nationkey") % 2 == 1
    return (
        _nation(spark, sf_dir)
        .filter("n_nationkey < 20")
        .select(
            F.col("n_name").alias("circuit_id"),
            F.when(street, "Street").otherwise("Permanent").alias("circuit_type"),
            (3 + F.col("n_nationkey") / F.lit(10.0)).alias("circuit_length"),
        )
    )


def daily_weather(spark, sf_dir) -> DataFrame:
    """One forecast per day of events: mean value as temperature, the share of
    errors as chance of rain, wet above a fifth."""
    share = F.sum((F.col("event_type") == "error").cast("int")) / F.count("*")
    mean = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("ts").cast("date").alias("forecast_date"))
        .agg((mean / 2).alias("temperature"), share.alias("rain_chance"))
        .select(
            F.lit("city").alias("city"),
            F.lit("country").alias("country"),
            "forecast_date",
            "temperature",
            F.lit("events").alias("description"),
            (F.col("rain_chance") > 0.2).alias("is_wet"),
            "rain_chance",
        )
    )


def event_calendar(spark, sf_dir) -> DataFrame:
    """A race per nation on the day of January 2024 its key counts to."""
    return _nation(spark, sf_dir).select(
        F.lit(SEASON).alias("season"),
        F.lower("n_name").alias("race_name"),
        F.lit("city").alias("city"),
        F.lit("country").alias("country"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).alias("race_date"),
    )


def tables(spark, sf_dir) -> Tables:
    rows = written_results(spark, sf_dir)
    return Tables(
        results=in_seasons(rows, SEASON - 3, SEASON - 1),
        qualifying=qualifying_of(rows),
        drivers=active_drivers(spark, sf_dir),
        driver_standings=driver_standings_of(rows),
        constructor_standings=constructor_standings_of(rows),
        entries=entries_of(rows),
        calendar=event_calendar(spark, sf_dir),
        circuit_aliases=circuit_aliases(spark, sf_dir),
        circuit_features=circuit_features(spark, sf_dir),
        weather=daily_weather(spark, sf_dir),
        order=ORDER,
        key=KEY,
        written=True,
    )
