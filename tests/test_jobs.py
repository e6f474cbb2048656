"""The user's questions, over a folder of captured documents."""

import json
import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paceline.functions.scalars import track_condition
from paceline.operators.model import TreeSettings
from paceline.plans import jobs
from paceline.plans.tables import from_landing
from paceline.session import materialize
from paceline.sources import dimensions, sinks
from paceline.sources.documents import read_table

DRIVERS = ["ann", "bob", "cat", "dan", "eve", "fay"]
TEAMS = {"ann": "red", "bob": "red", "cat": "blue", "dan": "blue", "eve": "gold", "fay": "gold"}
CIRCUITS = ["silverstone", "monza", "spa", "suzuka", "monaco"]
POINTS = [25, 18, 15, 12, 10, 8]
AS_OF = "2024-07-02"


def person(driver):
    return {"driverId": driver, "givenName": driver.title(), "familyName": "Smith"}


def write(root, path, body):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(body))


def races(*items):
    return {"MRData": {"RaceTable": {"Races": list(items)}}}


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("seasons")
    rng = random.Random(11)
    for season in range(2021, 2025):
        schedule = []
        for round_ in range(1, 11):
            circuit = CIRCUITS[round_ % 5]
            day = date(season, 3, 1) + timedelta(days=14 * round_)
            head = {
                "round": str(round_),
                "raceName": f"Race {round_}",
                "date": day.isoformat(),
                "Circuit": {"circuitId": circuit},
            }
            schedule.append(head)
            if season == 2024 and round_ > 8:
                continue
            order = sorted(DRIVERS, key=lambda d: DRIVERS.index(d) + rng.gauss(0, 1.5))
            grid = rng.sample(DRIVERS, 6)
            results = [
                {
                    "grid": str(grid.index(d) + 1),
                    "position": str(i + 1) if i < 5 else "R",
                    "points": str(POINTS[i]),
                    "status": "Finished",
                    "Driver": person(d),
                    "Constructor": {"constructorId": TEAMS[d], "name": TEAMS[d].title()},
                }
                for i, d in enumerate(order)
            ]
            where = f"season={season}/round={round_}/doc.json"
            write(root, f"results/{where}", races({**head, "Results": results}))
            quali = [
                {"position": str(i + 1), "Driver": {"driverId": d}} for i, d in enumerate(grid)
            ]
            write(root, f"qualifying/{where}", races({**head, "QualifyingResults": quali}))
        write(root, f"schedule/season={season}/doc.json", races(*schedule))
    write(
        root,
        "drivers/season=2024/doc.json",
        {"MRData": {"DriverTable": {"Drivers": [person(d) for d in DRIVERS]}}},
    )
    write(
        root,
        "entries/season=2024/circuit_id=silverstone/doc.json",
        {"MRData": {"DriverTable": {"Drivers": [person(d) for d in DRIVERS[:5]]}}},
    )
    listed = [
        {
            "points": str(100 - i),
            "wins": str(5 - i),
            "Driver": person(d),
            "Constructors": [{"constructorId": TEAMS[d]}],
        }
        for i, d in enumerate(DRIVERS)
    ]
    table = {"StandingsLists": [{"DriverStandings": listed}]}
    write(root, "driver_standings/season=2024/doc.json", {"MRData": {"StandingsTable": table}})
    teams = [
        {"points": "150", "wins": "3", "Constructor": {"constructorId": t, "name": t.title()}}
        for t in ("red", "blue", "gold")
    ]
    table = {"StandingsLists": [{"ConstructorStandings": teams}]}
    write(root, "constructor_standings/season=2024/doc.json", {"MRData": {"StandingsTable": table}})
    day = {
        "avgtemp_c": 31.0,
        "daily_will_it_rain": 0,
        "daily_chance_of_rain": 40,
        "condition": {"text": "Sunny"},
    }
    write(
        root,
        "weather/city=Silverstone/country=GB/forecast_date=2024-07-04/2024-07-02__doc.json",
        {"forecast": {"forecastday": [{"day": day}]}},
    )
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, landing):
    return from_landing(spark, landing)


@pytest.mark.parametrize("variant", ["faithful", "corrected"])
def test_predict_winner(tables, variant):
    prediction = jobs.predict_winner(
        tables, "United Kingdom", 2024, AS_OF, variant=variant, settings=TreeSettings(trees=5)
    )
    ranking = prediction.ranking.collect()
    assert prediction.ranking.columns == ["driver", "constructor_name", "win_probability"]
    # Only the drivers entered, each with a team and a probability, best first.
    assert {r["driver"] for r in ranking} == {f"{d.title()} Smith" for d in DRIVERS[:5]}
    chances = [r["win_probability"] for r in ranking]
    assert all(0 <= c <= 100 for c in chances) and chances == sorted(chances, reverse=True)
    assert all(r["constructor_name"] for r in ranking)
    assert 0 <= prediction.accuracy.first()["accuracy"] <= 1
    assert {r["class"] for r in prediction.class_report.collect()} >= {"accuracy", "macro avg"}
    importances = [r["importance"] for r in prediction.importances.collect()]
    # Corrected also tells the model what was missing: a flag per feature.
    assert len(importances) == (36 if variant == "corrected" else 18)
    assert sum(importances) == pytest.approx(1)


def test_a_prediction_leaves_the_matrices_and_the_ways(spark, tables):
    """What lies behind the matrices is deleted, with the tables themselves if the job makes them."""
    from test_session import tables as listed
    from test_session import written

    made = []

    def own():
        results = materialize(tables.results, "own_results")
        made.append("own_results" in written(spark))
        return replace(tables, results=results)

    before = listed(spark)
    prediction = jobs.predict_winner(own, "United Kingdom", 2024, AS_OF, settings=TreeSettings(trees=2))
    left = {n.rsplit("-", 1)[0] for n in listed(spark) - before}
    assert made == [True] and left <= {"train", "score", "ways", "ranked"}
    assert prediction.ranking.count() == 5
    assert prediction.learnt_from.count() > 0 and 0 <= prediction.accuracy.first()["accuracy"] <= 1
    classes = [r["count"] for r in prediction.learnt_from.groupBy("label").count().collect()]
    assert len(classes) == 2


def test_no_prediction_without_race_or_history(tables):
    assert jobs.predict_winner(tables, "Atlantis", 2024, AS_OF) is None
    assert jobs.predict_winner(tables, "United Kingdom", 2024, AS_OF, as_of_season=2010) is None


def test_past_winners(tables):
    rows = jobs.past_winners_at(tables, "Great Britain", 2024).collect()
    assert sorted(r["season"] for r in rows) == [2021, 2022, 2023]
    first = tables.results.filter("circuit_id = 'silverstone' and finish = 1 and round = 5")
    assert {(r["season"], r["driver"]) for r in rows} == {
        (r["season"], r["driver"]) for r in first.filter("season < 2024").collect()
    }


def test_recent_results(spark, tables, landing):
    schedule = read_table(spark, landing, "schedule")
    rows = jobs.recent_results(tables.results, schedule, 2024, "2024-06-01", n=2).collect()
    assert {r["race_name"] for r in rows} == {"Race 5", "Race 6"}
    assert len(rows) == 12


def test_race_day_forecast(spark, tables):
    asked = spark.createDataFrame(
        [(2024, "United Kingdom"), (2024, "Atlantis"), (2024, "Bahrain")], "season int, race_name string"
    )
    got = {
        r["race_name"]: r
        for r in jobs.race_day_forecast(asked, tables.calendar, tables.weather, AS_OF).collect()
    }
    assert got["United Kingdom"]["status"] == "ok"
    assert got["United Kingdom"]["track_condition"] == "Hot"
    assert got["United Kingdom"]["rain_chance"] == 0.4
    assert got["Atlantis"]["status"] == "unknown race"
    assert got["Bahrain"]["status"] == "out of reach"
    upcoming = jobs.upcoming_forecasts(tables.calendar, tables.weather, AS_OF).collect()
    assert [r["race_name"] for r in upcoming] == ["United Kingdom"]


def test_weather_falls_back_to_the_default(tables):
    races_ = tables.calendar.filter("season = 2024")
    rows = {r["race_name"]: r for r in jobs.weather_or_default(races_, tables.weather, AS_OF).collect()}
    assert rows["United Kingdom"]["temperature"] == 31.0
    other = rows["Monaco"]
    assert (other["temperature"], other["description"], other["is_wet"], other["rain_chance"]) == (
        25.0,
        "Unknown",
        False,
        0.0,
    )


def test_track_conditions(spark):
    cases = [(19.9, False, "Cool"), (20.0, False, "Moderate"), (29.9, False, "Moderate")]
    cases += [(30.0, False, "Hot"), (10.0, True, "Wet"), (35.0, True, "Wet")]
    df = spark.createDataFrame(cases, "t double, wet boolean, wanted string")
    assert df.filter(track_condition(F.col("t"), F.col("wet")) != F.col("wanted")).count() == 0


def test_dimensions(spark):
    calendar = dimensions.calendar(spark)
    assert {r["season"]: r["count"] for r in calendar.groupBy("season").count().collect()} == {
        2023: 22,
        2024: 24,
    }
    qatar = calendar.filter("season = 2024 and race_name = 'Qatar'").first()
    assert qatar["race_date"] == date(2024, 12, 1)
    names = spark.createDataFrame([("BRITAIN",), ("Nowhere",)], "name string")
    resolved = dimensions.resolve_circuit(names, "name", dimensions.circuit_aliases(spark))
    assert {r["circuit_id"] for r in resolved.collect()} == {"silverstone", "nowhere"}
    features = dimensions.with_circuit_features(resolved, dimensions.circuit_features(spark))
    got = {r["circuit_id"]: (r["circuit_type_code"], r["circuit_length"]) for r in features.collect()}
    assert got == {"silverstone": (0, 5.891), "nowhere": (2, 5.0)}
    # Every race of the calendars has a circuit with known features, but for two.
    places = dimensions.resolve_circuit(calendar, "race_name", dimensions.circuit_aliases(spark))
    unknown = dimensions.with_circuit_features(places, dimensions.circuit_features(spark))
    assert {r["circuit_id"] for r in unknown.filter("circuit_type_code = 2").collect()} == {
        "shanghai",
        "imola",
    }


def test_season_tables_and_sinks(spark, tables, landing, tmp_path):
    events = read_table(spark, landing, "schedule").withColumnRenamed("race_name", "track_name")
    sessions = tables.results.select(
        "season", "round", F.col("driver_id").alias("driver_number"), F.col("finish").cast("double").alias("position"), "points"
    )
    page = jobs.season_tables(tables, events, sessions, 2024, AS_OF)
    sinks.write_season_tables(page, str(tmp_path / "page"))
    read = lambda name: sinks.published(spark, str(tmp_path / "page"), name)
    assert read("current_season").count() == 8 * 6
    assert read("driver_standings").count() == 6
    assert read("upcoming_races").count() == 1
    assert jobs.recent_performance(tables.driver_standings, 2024).count() == 6

    sinks.write_results(tables.results, str(tmp_path / "results"))
    plan_of = spark.read.parquet(str(tmp_path / "results")).filter("season between 2021 and 2023")
    plan = plan_of._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    ranking = spark.createDataFrame([("Ann", "Red", 50.0)], "driver string, constructor_name string, win_probability double")
    sinks.write_ranking(ranking, str(tmp_path / "ranking"))
    sinks.write_model_report({"importances": ranking}, str(tmp_path / "report"))
    assert sinks.published(spark, str(tmp_path / "ranking"), "ranking").count() == 1
    assert sinks.published(spark, str(tmp_path / "report"), "importances").count() == 1


def test_a_failure_in_the_middle_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "page")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "page/_published").mkdir(parents=True)
        sinks.published(spark, path, "one")
    tables = lambda n, broken=False: {
        "one": spark.range(n), "two": spark.range(n).withColumn("x", F.raise_error(F.lit("no")) if broken else F.lit("x"))
    }
    sinks.publish(tables(3), path)
    with pytest.raises(Exception, match="no"):
        sinks.publish(tables(4, broken=True), path)
    assert [sinks.published(spark, path, n).count() for n in ("one", "two")] == [3, 3]
    sinks.publish(tables(5), path)
    assert [sinks.published(spark, path, n).count() for n in ("one", "two")] == [5, 5]
    sinks.forget_older(spark, path)
    assert sinks.published(spark, path, "one").count() == 5
    assert len([p for p in (tmp_path / "page").iterdir() if p.name.startswith("version=")]) == 1
