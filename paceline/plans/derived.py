"""Documents made from the star tables, in the shapes the sources read.

They are written as JSON text and parsed back, so the whole tables go through
the same parsing and flattening as captured files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.plans import star
from paceline.sources.documents import BAD, CAPTURED, document_schema


def _through_json(df: DataFrame, kind: str, keys: list[str], body: Column) -> DataFrame:
    """One document per row, as text and back."""
    schema = document_schema(kind)
    wanted = [f for f in schema.fields if f.name not in [*keys, BAD]]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted)
    parsed = F.from_json(F.to_json(body), ddl).alias("doc")
    return df.select(*keys, parsed).select(*keys, "doc.*")


def _person(key: str) -> list[Column]:
    return [
        F.col(key).cast("string").alias("driverId"),
        F.lit("Supplier").alias("givenName"),
        F.col(key).cast("string").alias("familyName"),
    ]


def result_documents(spark, sf_dir) -> DataFrame:
    """Each line as the one result of its race's document.  Retired lines have
    the position "R", untaxed ones an empty grid; dates are not zero-padded."""
    raw = star.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )
    rows = raw.join(star.races(spark, sf_dir), raw.l_orderkey == F.col("race_id")).join(
        star.drivers(spark, sf_dir).drop("s_acctbal"), raw.l_suppkey == F.col("driver_id")
    )
    result = F.struct(
        F.when(F.col("l_tax") == 0, "")
        .otherwise((F.col("l_partkey") % 20 + 1).cast("string"))
        .alias("grid"),
        F.when(F.col("l_returnflag") == "R", "R")
        .otherwise(F.col("l_linenumber").cast("string"))
        .alias("position"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_quantity") + 0.5).cast("string").alias("points"),
        F.struct(*_person("driver_id")).alias("Driver"),
        F.struct(
            F.col("constructor_id").cast("string").alias("constructorId"),
            F.col("constructor_name").alias("name"),
        ).alias("Constructor"),
    )
    race = F.struct(
        F.col("circuit_id").alias("raceName"),
        F.date_format("race_date", "yyyy-M-d").alias("date"),
        F.struct(F.col("circuit_id").alias("circuitId")).alias("Circuit"),
        F.array(result).alias("Results"),
    )
    body = F.struct(F.struct(F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData"))
    rows = rows.withColumn("round", F.col("race_id").cast("int"))
    return _through_json(rows, "results", ["season", "round"], body)


def _result_rows(spark, sf_dir) -> DataFrame:
    raw = star.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"
    )
    return raw.join(star.races(spark, sf_dir), raw.l_orderkey == F.col("race_id")).join(
        star.drivers(spark, sf_dir).drop("s_acctbal"), raw.l_suppkey == F.col("driver_id")
    )


#: Races whose results one document holds.
RACES_A_DOCUMENT = 4


def recaptured_texts(spark, sf_dir) -> DataFrame:
    """Texts of documents with the results of up to four races each, some requests answered again.

    Every fifth request has a newer answer: each race a day later, only drivers on even
    lines, which leaves some races without any.  Every seventh one has a still newer text
    that is cut short.  Every eleventh line lacks its driver's id, every thirteenth race its date.
    """
    result = F.struct(
        "l_linenumber",
        F.when(F.col("l_tax") == 0, "").otherwise((F.col("l_partkey") % 20 + 1).cast("string")).alias("grid"),
        F.when(F.col("l_returnflag") == "R", "R").otherwise(F.col("l_linenumber").cast("string")).alias("position"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_quantity") + 0.5).cast("string").alias("points"),
        F.struct(
            F.when((F.col("race_id") + F.col("l_linenumber")) % 11 != 0, F.col("driver_id").cast("string")).alias("driverId"),
            F.lit("Supplier").alias("givenName"),
            F.col("driver_id").cast("string").alias("familyName"),
        ).alias("Driver"),
        F.struct(
            F.col("constructor_id").cast("string").alias("constructorId"), F.col("constructor_name").alias("name")
        ).alias("Constructor"),
    )
    rows = _result_rows(spark, sf_dir).withColumn("round", F.floor(F.col("race_id") / RACES_A_DOCUMENT).cast("int"))
    # Dealt by document, which serves its races too.
    rows = rows.repartition("season", "round")
    # A race has few results and a document few races, so both lists stay short.
    races = rows.groupBy("season", "round", "race_id", "circuit_id", "race_date").agg(F.collect_list(result).alias("of"))

    def document(day: Column, kept: Column, asked: Column | None = None) -> Column:
        race = F.struct(
            F.col("circuit_id").alias("raceName"),
            F.when(F.col("race_id") % 13 != 0, F.date_format(day, "yyyy-M-d")).alias("date"),
            F.struct(F.col("circuit_id").alias("circuitId")).alias("Circuit"),
            kept.alias("Results"),
        )
        listed = F.struct(F.struct(F.struct(F.collect_list(race if asked is None else F.when(asked, race)).alias("Races")).alias("RaceTable")).alias("MRData"))
        return F.to_json(listed)

    first = document(F.col("race_date"), F.col("of"))
    again = F.col("round") % 5 == 0
    second = document(F.date_add("race_date", 1), F.filter("of", lambda r: r["l_linenumber"] % 2 == 0), again)
    answers = races.groupBy("season", "round").agg(first.alias("first"), second.alias("second"))
    texts = F.array(
        F.struct(F.lit(1).alias("at"), F.col("first").alias("value")),
        F.struct(F.lit(2).alias("at"), F.when(again, F.col("second")).alias("value")),
        F.struct(F.lit(3).alias("at"), F.when(F.col("round") % 7 == 0, F.substring("first", 1, 20)).alias("value")),
    )
    asked = answers.select("season", "round", F.explode(texts).alias("t")).filter("t.value is not null")
    captured = F.struct(
        F.lit(None).cast("date").alias("issued"), F.col("t.at").alias("at"), F.concat(F.lit("capture "), F.col("t.at")).alias("capture")
    )
    return asked.select("season", "round", captured.alias(CAPTURED), F.lit("made").alias("file_path"), F.col("t.value").alias("value"))


def qualifying_documents(spark, sf_dir) -> DataFrame:
    """Each line as the one qualifying result of a document; open lines' races
    have no qualifying."""
    rows = star.lines(spark, sf_dir).join(
        star.orders(spark, sf_dir).select("race_id", "season"), "race_id"
    )
    result = F.struct(
        F.col("line_no").cast("string").alias("position"),
        F.struct(F.col("driver_id").cast("string").alias("driverId")).alias("Driver"),
    )
    race = F.struct(F.when(F.col("status") == "F", F.array(result)).alias("QualifyingResults"))
    body = F.struct(F.struct(F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData"))
    rows = rows.withColumn("round", F.col("race_id").cast("int"))
    return _through_json(rows, "qualifying", ["season", "round"], body)


def schedule_documents(spark, sf_dir) -> DataFrame:
    race = F.struct(
        F.col("race_id").cast("string").alias("round"),
        F.concat(F.lit("Race "), F.col("race_id").cast("string")).alias("raceName"),
        F.date_format("race_date", "yyyy-M-d").alias("date"),
        F.struct(F.col("circuit_id").alias("circuitId")).alias("Circuit"),
    )
    body = F.struct(F.struct(F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData"))
    return _through_json(star.races(spark, sf_dir), "schedule", ["season"], body)


def driver_documents(spark, sf_dir) -> DataFrame:
    body = F.struct(
        F.struct(
            F.struct(F.array(F.struct(*_person("driver_id"))).alias("Drivers")).alias("DriverTable")
        ).alias("MRData")
    )
    rows = star.drivers(spark, sf_dir).withColumn("season", F.lit(star.SEASON))
    return _through_json(rows, "drivers", ["season"], body)


def entry_documents(spark, sf_dir) -> DataFrame:
    """The drivers of each race's entry list."""
    body = F.struct(
        F.struct(
            F.struct(F.array(F.struct(*_person("driver_id"))).alias("Drivers")).alias("DriverTable")
        ).alias("MRData")
    )
    rows = star.results(spark, sf_dir).select("season", "circuit_id", "driver_id").distinct()
    return _through_json(rows, "entries", ["season", "circuit_id"], body)


def _standings(rows: DataFrame, kind: str, table: str, entry: Column) -> DataFrame:
    """A standings document per row; in debt, the list of standings is empty."""
    lists = F.when(F.col("s_acctbal") < 0, F.array()).otherwise(
        F.array(F.struct(F.array(entry).alias(table)))
    )
    body = F.struct(
        F.struct(F.struct(lists.alias("StandingsLists")).alias("StandingsTable")).alias("MRData")
    )
    return _through_json(rows.withColumn("season", F.lit(star.SEASON)), kind, ["season"], body)


def driver_standing_documents(spark, sf_dir) -> DataFrame:
    """Balances as points; every driver is listed with a second team."""
    entry = F.struct(
        F.col("s_acctbal").cast("string").alias("points"),
        (F.col("driver_id") % 7).cast("string").alias("wins"),
        F.struct(*_person("driver_id")).alias("Driver"),
        F.array(
            F.struct(F.col("constructor_id").cast("string").alias("constructorId")),
            F.struct(F.lit("second").alias("constructorId")),
        ).alias("Constructors"),
    )
    return _standings(
        star.drivers(spark, sf_dir), "driver_standings", "DriverStandings", entry
    )


def constructor_standing_documents(spark, sf_dir) -> DataFrame:
    entry = F.struct(
        F.col("s_acctbal").cast("string").alias("points"),
        (F.col("driver_id") % 7).cast("string").alias("wins"),
        F.struct(
            F.col("driver_id").cast("string").alias("constructorId"),
            F.col("constructor_name").alias("name"),
        ).alias("Constructor"),
    )
    return _standings(
        star.drivers(spark, sf_dir), "constructor_standings", "ConstructorStandings", entry
    )


def overlapping_weather_documents(spark, sf_dir) -> DataFrame:
    """The forecasts of ``weather_documents``, all for one place; of those made on a
    day, that of the last event is the newest capture."""
    documents = weather_documents(spark, sf_dir)
    captured = F.struct(F.col("forecast_date").alias("issued"), F.col("city").cast("bigint").alias("at"))
    return documents.withColumn(CAPTURED, captured).withColumn("city", F.lit("city"))


def weather_documents(spark, sf_dir) -> DataFrame:
    """A two-day forecast per event."""

    def day(shift: int) -> Column:
        return F.struct(
            F.struct(
                (F.col("value") + shift).alias("avgtemp_c"),
                (F.col("event_type") == "error").cast("int").alias("daily_will_it_rain"),
                (F.col("event_id") % 101).cast("int").alias("daily_chance_of_rain"),
                F.struct(F.col("event_type").alias("text")).alias("condition"),
            ).alias("day")
        )

    body = F.struct(F.struct(F.array(day(0), day(1)).alias("forecastday")).alias("forecast"))
    rows = star.read(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "value",
        F.col("event_id").cast("string").alias("city"),
        F.lit("XX").alias("country"),
        F.col("ts").cast("date").alias("forecast_date"),
    )
    return _through_json(rows, "weather", ["city", "country", "forecast_date"], body)
