"""Captured JSON documents: one parallel scan per kind, then flattened.

A landing folder has one folder per kind, below it the request a document
answers (``results/season=2024/round=3/doc.json``).  Every document of a file is
read or set aside, whatever the file's layout: files named ``.jsonl`` or
``.ndjson`` hold a document per line and can be split between tasks; any other
file is looked at whole, and is taken line by line if its first line is a
document by itself.

A capture is one answer to a request (the values of a kind's path columns).  A
file is a capture by itself; files ``<capture>__<page>.json`` of one request are
one capture together, and a capture named after a day (``2024-07-02__...``) tells
when a forecast was made.  The newest capture of a request that has a document
that can be read stands for it whole: what older ones say is gone, rows that the
newest no longer holds too (``manifest``, ``current``).  Rows without a value they
must have are set aside with the reasons (``accepted``, ``rejected``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.scalars import (
    digits_to_int,
    full_name,
    parse_day,
    percent_to_fraction,
)
from paceline.schemas import DOCUMENTS, PATH_COLUMNS

BAD = "unreadable"
CAPTURED = "captured"
ROOTS = {"weather": "forecast", "event_schedule": "EventName", "session_results": "DriverNumber"}

#: What makes a row of a kind's table one of its kind.
KEYS = {
    "drivers": ["season", "driver_id"],
    "entries": ["season", "circuit_id", "driver_id"],
    "driver_standings": ["season", "driver_id"],
    "constructor_standings": ["season", "constructor_id"],
    "schedule": ["season", "round"],
    "results": ["season", "round", "race_name", "race_date", "driver_id"],
    "qualifying": ["season", "round", "driver_id"],
    "weather": ["city", "country", "forecast_date"],
    "event_schedule": ["season", "round"],
    "session_results": ["season", "round", "driver_number"],
}

#: Values without which a row is none, and what is made of them can't be told apart.
MANDATORY = {
    "drivers": ["season", "driver_id"],
    "entries": ["season", "circuit_id", "driver_id"],
    "driver_standings": ["season", "driver_id"],
    "constructor_standings": ["season", "constructor_id"],
    "schedule": ["season", "round", "circuit_id", "race_date"],
    "results": ["season", "round", "circuit_id", "race_date", "driver_id"],
    "qualifying": ["season", "round", "driver_id"],
    "weather": ["city", "country", "forecast_date"],
    "event_schedule": ["season", "round"],
    "session_results": ["season", "round", "driver_number"],
}

REASONS = "reasons"

_LINE_ENDINGS = (".jsonl", ".ndjson")
_LINES = "*{" + ",".join(_LINE_ENDINGS) + "}"
# Every other name: it parts from each of those endings at some character from its end.
_WHOLE = "{*[!ln]," + ",".join(f"*[!{e[-k - 1]}]{e[-k:]}" for e in _LINE_ENDINGS for k in range(1, len(e))) + "}"


def path_columns(kind: str) -> list[str]:
    return [c.split()[0] for c in PATH_COLUMNS[kind].split(", ")]


def document_schema(kind: str) -> T.StructType:
    return T._parse_datatype_string(f"{DOCUMENTS[kind]}, {PATH_COLUMNS[kind]}, {BAD} string")


def parse_texts(texts: DataFrame, text: str, fields: str) -> DataFrame:
    """A row per document of each text: the other columns, ``fields`` and, for
    what does not parse, the text as ``unreadable``.

    A text whose first line is a document by itself holds a document per line.
    A text with anything after its document does not parse.
    """
    schema = f"array<struct<{_struct_fields(fields)}>>"
    others = [c for c in texts.columns if c != text]

    def documents(t: Column) -> Column:
        # Between brackets a text must be read to its end.
        return F.from_json(F.concat(F.lit("["), t, F.lit("]")), schema)

    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x) != "")
    per_line = (F.size(lines) > 1) & documents(F.get(lines, F.lit(0))).isNotNull()
    pieces = F.when(per_line, lines).otherwise(F.array(F.col(text)))
    parsed = texts.select(*others, F.explode(pieces).alias("__text")).withColumn("__docs", documents(F.col("__text")))
    bad = F.col("__docs").isNull() | (F.size("__docs") == 0)
    names = [f.name for f in T._parse_datatype_string(fields).fields]
    return parsed.select(
        *others, F.explode_outer("__docs").alias("__doc"), F.when(bad, F.col("__text")).alias(BAD)
    ).select(*others, *[F.col(f"__doc.{n}").alias(n) for n in names], BAD)


def _struct_fields(fields: str) -> str:
    parsed = T._parse_datatype_string(fields)
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in parsed.fields)


def _captured(kind: str) -> Column:
    """What tells captures apart, and which of two is newer: of forecasts the day they
    were made, then when the file was written.

    A forecast that does not say when it was made was made on its first day.
    """
    file = F.col("_metadata.file_path")
    # Files of one capture have all but what follows the last "__" in common.
    capture = F.regexp_replace(file, r"__[^/]*$", "")
    said = F.try_to_timestamp(F.regexp_extract(capture, r"([^/]*)$", 1).substr(1, 10), F.lit("yyyy-MM-dd")).cast("date")
    issued = F.coalesce(said, F.col("forecast_date")) if kind == "weather" else F.lit(None).cast("date")
    return F.struct(issued.alias("issued"), F.col("_metadata.file_modification_time").alias("at"), capture.alias("capture"))


def _texts(reader, landing: str, kind: str) -> DataFrame:
    """The kind's files as texts, with path columns, file_path and ``captured``."""
    path, schema = f"{landing.rstrip('/')}/{kind}", f"value string, {PATH_COLUMNS[kind]}"
    whole = reader().schema(schema).option("pathGlobFilter", _WHOLE).text(path, wholetext=True)
    lines = reader().schema(schema).option("pathGlobFilter", _LINES).text(path)
    out = None
    for part in (whole, lines.filter(F.trim("value") != "")):
        part = part.withColumn("file_path", F.col("_metadata.file_path")).withColumn(CAPTURED, _captured(kind))
        out = part if out is None else out.unionByName(part)
    return out


def read_documents(spark: SparkSession, landing: str, kind: str) -> DataFrame:
    """All documents of a kind, unreadable ones included (see ``quarantine``)."""
    return parse_texts(_texts(lambda: spark.read, landing, kind), "value", DOCUMENTS[kind])


def stream_documents(spark: SparkSession, landing: str, kind: str) -> DataFrame:
    """As ``read_documents``, those that arrive from now on."""
    return parse_texts(_texts(lambda: spark.readStream, landing, kind), "value", DOCUMENTS[kind])


def _is_bad(kind: str) -> Column:
    return F.col(BAD).isNotNull() | F.col(ROOTS.get(kind, "MRData")).isNull()


def readable(documents: DataFrame, kind: str, root: str | None = None) -> DataFrame:
    """Documents that parsed and have their kind's (or the given) root."""
    bad = F.col(BAD).isNotNull() | F.col(root).isNull() if root else _is_bad(kind)
    return documents.filter(~bad).drop(BAD, "file_path")


def quarantine(documents: DataFrame, kind: str, root: str | None = None) -> DataFrame:
    """Documents left out: where each came from, and its text if it did not parse."""
    bad = F.col(BAD).isNotNull() | F.col(root).isNull() if root else _is_bad(kind)
    fields = T._parse_datatype_string(DOCUMENTS[kind]).names if kind in DOCUMENTS else [root]
    return documents.filter(bad).drop(*fields, CAPTURED)


def _first(array: str) -> Column:
    return F.get(F.col(array), F.lit(0))


# Flatteners: documents -> tables


def flatten_drivers(documents: DataFrame) -> DataFrame:
    return documents.select(
        "season", F.explode("MRData.DriverTable.Drivers").alias("d")
    ).select(
        "season",
        F.col("d.driverId").alias("driver_id"),
        full_name(F.col("d.givenName"), F.col("d.familyName")).alias("driver"),
    )


def flatten_entries(documents: DataFrame) -> DataFrame:
    return documents.select(
        "season", "circuit_id", F.explode("MRData.DriverTable.Drivers").alias("d")
    ).select("season", "circuit_id", F.col("d.driverId").alias("driver_id"))


def flatten_driver_standings(documents: DataFrame) -> DataFrame:
    """The first list of each document; a driver's first team only."""
    first_list = _first("MRData.StandingsTable.StandingsLists")
    return documents.select(
        "season", F.explode(first_list["DriverStandings"]).alias("s")
    ).select(
        "season",
        F.col("s.Driver.driverId").alias("driver_id"),
        full_name(F.col("s.Driver.givenName"), F.col("s.Driver.familyName")).alias("driver"),
        _first("s.Constructors")["constructorId"].alias("constructor_id"),
        F.col("s.points").try_cast("double").alias("points"),
        F.col("s.wins").try_cast("int").alias("wins"),
    )


def flatten_constructor_standings(documents: DataFrame) -> DataFrame:
    first_list = _first("MRData.StandingsTable.StandingsLists")
    return documents.select(
        "season", F.explode(first_list["ConstructorStandings"]).alias("s")
    ).select(
        "season",
        F.col("s.Constructor.constructorId").alias("constructor_id"),
        F.col("s.Constructor.name").alias("constructor_name"),
        F.col("s.points").try_cast("double").alias("constructor_points"),
        F.col("s.wins").try_cast("int").alias("constructor_wins"),
    )


def flatten_schedule(documents: DataFrame) -> DataFrame:
    return documents.select("season", F.explode("MRData.RaceTable.Races").alias("r")).select(
        "season",
        F.col("r.round").try_cast("int").alias("round"),
        F.col("r.raceName").alias("race_name"),
        F.col("r.Circuit.circuitId").alias("circuit_id"),
        parse_day(F.col("r.date")).alias("race_date"),
    )


def flatten_results(documents: DataFrame) -> DataFrame:
    """Results of every race in a document."""
    return (
        documents.select("season", "round", F.explode("MRData.RaceTable.Races").alias("race"))
        .select(
            "season",
            "round",
            F.col("race.raceName").alias("race_name"),
            F.col("race.Circuit.circuitId").alias("circuit_id"),
            parse_day(F.col("race.date")).alias("race_date"),
            F.explode("race.Results").alias("r"),
        )
        .select(
            "season",
            "round",
            "race_name",
            "circuit_id",
            "race_date",
            F.col("r.Driver.driverId").alias("driver_id"),
            full_name(F.col("r.Driver.givenName"), F.col("r.Driver.familyName")).alias("driver"),
            F.col("r.Constructor.constructorId").alias("constructor_id"),
            F.col("r.Constructor.name").alias("constructor_name"),
            digits_to_int(F.col("r.grid")).alias("grid"),
            digits_to_int(F.col("r.position")).alias("finish"),
            F.col("r.status").alias("status"),
            F.col("r.points").try_cast("double").alias("points"),
        )
    )


def flatten_qualifying(documents: DataFrame) -> DataFrame:
    """Qualifying positions of every race in a document; a race without any gives no rows."""
    races = documents.select("season", "round", F.explode("MRData.RaceTable.Races").alias("race"))
    return races.select("season", "round", F.explode("race.QualifyingResults").alias("q")).select(
        "season",
        "round",
        F.col("q.Driver.driverId").alias("driver_id"),
        F.col("q.position").try_cast("int").alias("position"),
    )


def flatten_weather(documents: DataFrame) -> DataFrame:
    """One row per forecast day; later days of a document follow its date."""
    return documents.select(
        "city",
        "country",
        "forecast_date",
        F.posexplode("forecast.forecastday").alias("ahead", "f"),
    ).select(
        "city",
        "country",
        F.date_add("forecast_date", F.col("ahead")).alias("forecast_date"),
        F.col("f.day.avgtemp_c").alias("temperature"),
        F.col("f.day.condition.text").alias("description"),
        F.col("f.day.daily_will_it_rain").eqNullSafe(F.lit(1)).alias("is_wet"),
        percent_to_fraction(F.col("f.day.daily_chance_of_rain")).alias("rain_chance"),
    )


def flatten_event_schedule(rows: DataFrame) -> DataFrame:
    return rows.select(
        "season",
        F.col("RoundNumber").alias("round"),
        F.col("EventName").alias("track_name"),
        F.col("EventDate").alias("race_date"),
    )


def flatten_session_results(rows: DataFrame) -> DataFrame:
    return rows.select(
        "season",
        "round",
        F.col("DriverNumber").alias("driver_number"),
        F.col("Position").alias("position"),
        F.col("Points").alias("points"),
    )


FLATTENERS = {
    "drivers": flatten_drivers,
    "entries": flatten_entries,
    "driver_standings": flatten_driver_standings,
    "constructor_standings": flatten_constructor_standings,
    "schedule": flatten_schedule,
    "results": flatten_results,
    "qualifying": flatten_qualifying,
    "weather": flatten_weather,
    "event_schedule": flatten_event_schedule,
    "session_results": flatten_session_results,
}


def flatten(documents: DataFrame, kind: str) -> DataFrame:
    """The rows of readable documents, with ``captured`` if the documents have it."""
    if CAPTURED not in documents.columns:
        return FLATTENERS[kind](documents)
    # A flattener hands its first path column on as it is, so that carries the capture.
    carrier = path_columns(kind)[0]
    packed = documents.withColumn(carrier, F.struct(F.col(carrier).alias("own"), CAPTURED))
    rows = FLATTENERS[kind](packed)
    return rows.withColumn(CAPTURED, F.col(f"{carrier}.{CAPTURED}")).withColumn(carrier, F.col(f"{carrier}.own"))


def newest(rows: DataFrame, kind: str) -> DataFrame:
    """One row per key: that of the newest capture.  A maximum per key, so each
    task sends on one row for it."""
    keys = KEYS[kind]
    rest = [c for c in rows.columns if c not in (*keys, CAPTURED)]
    # A row that says more wins over an equally new one, so the choice never depends on order.
    best = F.max(F.struct(CAPTURED, *rest)) if rest else F.max(F.struct(CAPTURED))
    columns = [c for c in rows.columns if c != CAPTURED]
    return rows.groupBy(*keys).agg(best.alias("best")).select(
        *[F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in columns]
    )


# Captures: one answer to a request, replaced as a whole


def manifest(documents: DataFrame, kind: str) -> DataFrame:
    """A row per capture of the readable ``documents``: its request, ``capture``, when it was written, and its documents."""
    capture = F.col(f"{CAPTURED}.capture").alias("capture")
    return documents.groupBy(*path_columns(kind), capture).agg(
        F.max(f"{CAPTURED}.at").alias("at"), F.count(F.lit(1)).alias("documents")
    )


def latest(captures: DataFrame, kind: str) -> DataFrame:
    """The capture that stands for each request, of a manifest: the one written last."""
    best = F.max(F.struct("at", "capture"))
    return captures.groupBy(*path_columns(kind)).agg(best.alias("best")).select(*path_columns(kind), "best.capture")


def superseded(captures: DataFrame, kind: str) -> DataFrame:
    """The captures of a manifest that a newer one of their request replaces."""
    # A request has few captures; over a window the documents behind them are read once.
    last = F.max(F.struct("at", "capture")).over(Window.partitionBy(*path_columns(kind)))
    marked = captures.withColumn("__last", last["capture"])
    old = ~F.coalesce(F.col("capture") == F.col("__last"), F.lit(False))
    return marked.filter(old).select(*path_columns(kind), "capture").distinct()


def _without(rows: DataFrame, old: DataFrame, request: dict[str, Column]) -> DataFrame:
    old = old.toDF(*(f"__old_{c}" for c in old.columns))
    same = F.col(f"{CAPTURED}.capture") == F.col("__old_capture")
    for name, value in request.items():
        same = same & value.eqNullSafe(F.col(f"__old_{name}"))
    return rows.join(old, same, "left_anti")


def current(documents: DataFrame, kind: str) -> DataFrame:
    """Readable documents without those of superseded captures."""
    old = superseded(manifest(documents, kind), kind)
    return _without(documents, old, {c: F.col(c) for c in path_columns(kind)})


def current_rows(rows: DataFrame, kind: str, captures: DataFrame) -> DataFrame:
    """As ``current``, for flat rows and the manifest of the documents they come from.

    A capture that gave no rows replaces its request's older rows all the same.
    """
    # A row of a forecast has the day it is for; what it was asked for is its document's.
    of = [c for c in path_columns(kind) if c in rows.columns and not (kind == "weather" and c == "forecast_date")]
    return _without(rows, superseded(captures, kind), {c: F.col(c) for c in of})


# Rows that lack what they must have


def _reasons(kind: str) -> Column:
    lacking = [
        F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"no {c}")) for c in MANDATORY[kind]
    ]
    return F.array_compact(F.array(*lacking))


def accepted(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with all values that one of their kind must have."""
    return rows.filter(F.size(_reasons(kind)) == 0)


def rejected(rows: DataFrame, kind: str) -> DataFrame:
    """The other rows, with ``reasons``."""
    return rows.withColumn(REASONS, _reasons(kind)).filter(F.size(REASONS) > 0)


def _current_rows_of(spark: SparkSession, landing: str, kind: str) -> DataFrame:
    return flatten(current(readable(read_documents(spark, landing, kind), kind), kind), kind)


def read_table(spark: SparkSession, landing: str, kind: str) -> DataFrame:
    """The flat table of a kind: the rows of each request's newest capture, the newest row of each key."""
    return newest(accepted(_current_rows_of(spark, landing, kind), kind), kind)


def read_rejects(spark: SparkSession, landing: str, kind: str) -> DataFrame:
    """The rows that ``read_table`` leaves out for what they lack."""
    return rejected(_current_rows_of(spark, landing, kind), kind).drop(CAPTURED)


# Forecasts as of a day


def issued_forecasts(rows: DataFrame) -> DataFrame:
    """Flat forecasts with ``issued``, the day they were made; of those made on one day the newest."""
    keys = ["city", "country", "forecast_date", "issued"]
    rest = [c for c in rows.columns if c not in (*keys, CAPTURED)]
    dated = rows.withColumn("issued", F.col(f"{CAPTURED}.issued"))
    best = dated.groupBy(*keys).agg(F.max(F.struct(CAPTURED, *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def read_forecasts(spark: SparkSession, landing: str) -> DataFrame:
    """All forecasts ever made, with the day they were made."""
    return issued_forecasts(accepted(_current_rows_of(spark, landing, "weather"), "weather"))


def with_race(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add a race's circuit and date to rows that only know its round."""
    races = schedule.select("season", "round", "circuit_id", "race_date")
    return rows.join(races, ["season", "round"])
