"""Captured documents: every case the sources have to cope with."""

import json
import os
from datetime import date

import pytest

from paceline.sources import documents as docs


def write(root, path, body):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(body if isinstance(body, str) else json.dumps(body))


def races(*items):
    return {"MRData": {"RaceTable": {"Races": list(items)}}}


def result(driver, grid, position, points, status="Finished", team="red"):
    return {
        "grid": grid,
        "position": position,
        "points": points,
        "status": status,
        "Driver": {"driverId": driver, "givenName": driver.title(), "familyName": "Smith"},
        "Constructor": {"constructorId": team, "name": team.title()},
    }


def race(name, day, circuit, results=None, **more):
    body = {"raceName": name, "date": day, "Circuit": {"circuitId": circuit}, **more}
    if results is not None:
        body["Results"] = results
    return body


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    write(
        root,
        "results/season=2023/round=1/doc.json",
        races(
            race(
                "First",
                "2023-3-5",
                "sand",
                [
                    result("ann", "1", "1", "25.5"),
                    result("bob", "", "R", "0", "Engine"),
                    result("cat", "-1", " 3", "15"),
                ],
            )
        ),
    )
    write(
        root,
        "results/season=2023/round=2/doc.json",
        races(
            race("Second", "2023-03-19", "hill", [result("ann", "2", "2", "18")]),
            race("Again", "2023-03-20", "hill", [result("bob", "1", "1", "25")]),
        ),
    )
    write(root, "results/season=2023/round=3/doc.json", '{"MRData": {"RaceTable": {"Rac')
    write(root, "results/season=2023/round=4/doc.json", {"error": "not found"})
    write(
        root,
        "qualifying/season=2023/round=1/doc.json",
        races({"QualifyingResults": [{"position": "2", "Driver": {"driverId": "ann"}}]}),
    )
    write(root, "qualifying/season=2023/round=2/doc.json", races({"raceName": "Second"}))
    write(root, "qualifying/season=2023/round=3/doc.json", races())
    write(
        root,
        "schedule/season=2023/doc.json",
        races(
            {**race("First", "2023-3-5", "sand"), "round": "1"},
            {**race("Second", "2023-03-19", "hill"), "round": "2"},
        ),
    )
    standings = {
        "points": "25.5",
        "wins": "1",
        "Driver": {"driverId": "ann", "givenName": "Ann", "familyName": "Smith"},
        "Constructors": [{"constructorId": "red"}, {"constructorId": "blue"}],
    }
    table = {"MRData": {"StandingsTable": {"StandingsLists": [{"DriverStandings": [standings]}]}}}
    write(root, "driver_standings/season=2023/doc.json", table)
    empty = {"MRData": {"StandingsTable": {"StandingsLists": []}}}
    write(root, "driver_standings/season=2024/doc.json", empty)
    write(root, "constructor_standings/season=2024/doc.json", empty)
    day = {"avgtemp_c": 19.5, "daily_will_it_rain": 0, "daily_chance_of_rain": 40}
    days = [{"day": {**day, "condition": {"text": "Sunny"}}}, {"day": {**day, "condition": {"text": "Rain"}, "daily_will_it_rain": 1}}]
    write(
        root,
        "weather/city=Sakhir/country=BH/forecast_date=2024-02-29/doc.json",
        {"forecast": {"forecastday": days}},
    )
    write(root, "event_schedule/season=2023/doc.json", {"RoundNumber": 1, "EventName": "First", "EventDate": "2023-03-05"})
    write(root, "session_results/season=2023/round=1/doc.json", {"DriverNumber": "44", "Position": 1.0, "Points": 25.0})
    people = {"MRData": {"DriverTable": {"Drivers": [{"driverId": "ann", "givenName": "Ann", "familyName": "Smith"}]}}}
    write(root, "drivers/season=2023/doc.json", people)
    write(root, "entries/season=2023/circuit_id=sand/doc.json", people)
    return str(root)


def rows(spark, landing, kind):
    return docs.read_table(spark, landing, kind).collect()


def test_results(spark, landing):
    by_key = {(r["round"], r["driver_id"]): r for r in rows(spark, landing, "results")}
    assert set(by_key) == {(1, "ann"), (1, "bob"), (1, "cat"), (2, "ann"), (2, "bob")}
    ann = by_key[1, "ann"]
    assert (ann["points"], ann["grid"], ann["finish"]) == (25.5, 1, 1)
    assert ann["race_date"] == date(2023, 3, 5)
    assert ann["driver"] == "Ann Smith"
    assert ann["constructor_name"] == "Red"
    for driver in ("bob", "cat"):
        assert by_key[1, driver]["grid"] is None
        assert by_key[1, driver]["finish"] is None


def test_bad_documents_are_set_aside(spark, landing):
    bad = docs.quarantine(docs.read_documents(spark, landing, "results"), "results").collect()
    assert sorted(r["round"] for r in bad) == [3, 4]
    assert all("round=" in r["file_path"] for r in bad)


def test_races_without_qualifying_give_no_rows(spark, landing):
    assert [(r["round"], r["driver_id"], r["position"]) for r in rows(spark, landing, "qualifying")] == [(1, "ann", 2)]


def test_qualifying_gets_its_race(spark, landing):
    quali = docs.read_table(spark, landing, "qualifying")
    got = docs.with_race(quali, docs.read_table(spark, landing, "schedule")).collect()
    assert [(r["circuit_id"], r["race_date"]) for r in got] == [("sand", date(2023, 3, 5))]


def test_standings_take_the_first_team_and_may_be_empty(spark, landing):
    got = rows(spark, landing, "driver_standings")
    assert [(r["season"], r["constructor_id"], r["points"], r["wins"]) for r in got] == [(2023, "red", 25.5, 1)]
    none = docs.read_table(spark, landing, "constructor_standings")
    assert none.columns[-1] == "constructor_wins" and none.count() == 0


def test_weather_days_follow_the_documents_date(spark, landing):
    got = sorted(rows(spark, landing, "weather"), key=lambda r: r["forecast_date"])
    assert [r["forecast_date"] for r in got] == [date(2024, 2, 29), date(2024, 3, 1)]
    assert [r["is_wet"] for r in got] == [False, True]
    assert got[0]["rain_chance"] == 0.4 and got[0]["description"] == "Sunny"


def test_people_and_sessions(spark, landing):
    assert rows(spark, landing, "drivers")[0]["driver"] == "Ann Smith"
    assert rows(spark, landing, "entries")[0]["circuit_id"] == "sand"
    assert rows(spark, landing, "event_schedule")[0]["track_name"] == "First"
    assert rows(spark, landing, "session_results")[0]["driver_number"] == "44"


def one_and_two():
    one = races(race("First", "2023-03-05", "sand", [result("ann", "1", "1", "25")]))
    two = races(race("First", "2023-03-05", "sand", [result("bob", "2", "2", "18")]))
    three = races(race("First", "2023-03-05", "sand", [result("cat", "3", "3", "15")]))
    return one, two, three


@pytest.mark.parametrize("name", ["all.json", "all.jsonl", "all.ndjson"])
def test_a_document_per_line_whatever_the_name(spark, tmp_path, name):
    one, two, three = map(json.dumps, one_and_two())
    write(tmp_path, f"results/season=2023/round=1/{name}", "\n".join([one, '{"broken', two, "", three]))
    got = docs.read_table(spark, str(tmp_path), "results").collect()
    assert sorted(r["driver_id"] for r in got) == ["ann", "bob", "cat"]
    bad = docs.quarantine(docs.read_documents(spark, str(tmp_path), "results"), "results").collect()
    assert [r["unreadable"] for r in bad] == ['{"broken']


def test_a_document_over_several_lines_with_more_after_it_is_set_aside(spark, tmp_path):
    one, two, _ = one_and_two()
    write(tmp_path, "results/season=2023/round=1/a.json", json.dumps(one, indent=1))
    write(tmp_path, "results/season=2023/round=2/b.json", json.dumps(one, indent=1) + "\n" + json.dumps(two, indent=1))
    documents = docs.read_documents(spark, str(tmp_path), "results")
    assert [r["round"] for r in docs.readable(documents, "results").collect()] == [1]
    assert [r["round"] for r in docs.quarantine(documents, "results").collect()] == [2]


def at(path, seconds):
    os.utime(path, (1_700_000_000 + seconds, 1_700_000_000 + seconds))


def test_a_capture_replaces_the_older_ones_of_its_request(spark, tmp_path):
    # A corrected date, a driver who is gone, one whose points changed; another round stays.
    old = races(race("First", "2023-03-05", "sand", [result(d, "1", "1", "25") for d in ("ann", "bob", "cat")]))
    new = races(race("First", "2023-03-06", "sand", [result("ann", "1", "1", "26"), result("bob", "1", "1", "25")]))
    for i, (path, body) in enumerate([("round=1/0", old), ("round=2/0", old), ("round=1/1", new), ("round=1/2", "{broken"), ("round=1/3", {"error": "no"})]):
        write(tmp_path, f"results/season=2023/{path}.json", body)
        at(tmp_path / f"results/season=2023/{path}.json", i)
    got = docs.read_table(spark, str(tmp_path), "results").collect()
    assert sorted((r["round"], r["driver_id"], str(r["race_date"]), r["points"]) for r in got) == [
        (1, "ann", "2023-03-06", 26.0), (1, "bob", "2023-03-06", 25.0),
        (2, "ann", "2023-03-05", 25.0), (2, "bob", "2023-03-05", 25.0), (2, "cat", "2023-03-05", 25.0),
    ]
    # The two that can't be read replaced nothing.
    documents = docs.readable(docs.read_documents(spark, str(tmp_path), "results"), "results")
    gone = docs.superseded(docs.manifest(documents, "results"), "results").collect()
    assert [(r["round"], r["capture"].rsplit("/", 1)[1]) for r in gone] == [(1, "0.json")]


def test_a_capture_may_have_several_files_or_no_rows(spark, tmp_path):
    one, two, three = one_and_two()
    for i, (path, body) in enumerate([("1/a__0", three), ("1/b__0", one), ("1/b__1", two), ("2/a", one), ("2/b", races())]):
        write(tmp_path, f"results/season=2023/round={path}.json", body)
        at(tmp_path / f"results/season=2023/round={path}.json", i)
    got = docs.read_table(spark, str(tmp_path), "results").collect()
    assert sorted((r["round"], r["driver_id"]) for r in got) == [(1, "ann"), (1, "bob")]


def test_rows_without_what_they_must_have_are_set_aside(spark, tmp_path):
    nameless = {**result("x", "1", "1", "5"), "Driver": {"givenName": "No", "familyName": "Id"}}
    blank = {**result("x", "1", "1", "5"), "Driver": {"driverId": " "}}
    write(tmp_path, "results/season=2023/round=1/a.json", races(race("First", "2023-03-05", "sand", [result("ann", "1", "1", "25"), nameless, blank])))
    write(tmp_path, "results/season=2023/round=2/a.json", races(race("Second", "soon", "sand", [result("ann", "1", "1", "25")])))
    assert [(r["round"], r["driver_id"]) for r in docs.read_table(spark, str(tmp_path), "results").collect()] == [(1, "ann")]
    rejects = docs.read_rejects(spark, str(tmp_path), "results").collect()
    assert sorted((r["round"], r["driver"], r["reasons"]) for r in rejects if r["driver"]) == [
        (1, "No Id", ["no driver_id"]), (2, "Ann Smith", ["no race_date"])
    ]
    assert len(rejects) == 3


def forecast(path, temperature, days=1):
    day = {"day": {"avgtemp_c": temperature, "daily_will_it_rain": 0, "daily_chance_of_rain": 0, "condition": {"text": path}}}
    return {"forecast": {"forecastday": [day] * days}}


def test_a_forecast_made_later_changes_nothing(spark, tmp_path):
    from paceline.plans import jobs

    folder = "weather/city=x/country=y/forecast_date="
    for path, temperature, days in [
        ("2024-07-01/doc", 10.0, 5), ("2024-07-02/doc", 12.0, 2), ("2024-07-05/2024-07-03__doc", 30.0, 1), ("2024-07-04/doc", 40.0, 3),
        ("2024-07-03/2024-07-02__doc", 13.0, 1),
    ]:
        write(tmp_path, f"{folder}{path}.json", forecast(path, temperature, days))
    weather = docs.read_forecasts(spark, str(tmp_path))
    races_ = spark.createDataFrame([("x", "y", f"2024-07-0{d}") for d in range(2, 7)], "city string, country string, day string")
    races_ = races_.selectExpr("city", "country", "to_date(day) as race_date")
    got = lambda day: {str(r["race_date"])[-1]: r["temperature"] for r in jobs.weather_or_default(races_, weather, day).collect()}
    assert got("2024-07-01") == {"2": 10.0, "3": 10.0, "4": 10.0, "5": 10.0, "6": 25.0}
    assert got("2024-07-02") == {"2": 12.0, "3": 13.0, "4": 10.0, "5": 10.0, "6": 25.0}
    assert got("2024-07-03") == {"2": 25.0, "3": 13.0, "4": 10.0, "5": 30.0, "6": 25.0}
    assert got("2024-07-04") == {"2": 25.0, "3": 25.0, "4": 40.0, "5": 40.0, "6": 40.0}
    each = races_.selectExpr("*", "date_sub(race_date, 1) as as_of").unionByName(races_.selectExpr("*", "race_date as as_of"))
    joined = {(str(r["race_date"])[-1], str(r["as_of"])[-1]): r["temperature"] for r in jobs.join_forecasts_as_of(each, weather, "as_of").collect()}
    assert joined == {
        ("2", "1"): 10.0, ("3", "2"): 13.0, ("4", "3"): 10.0, ("5", "4"): 40.0, ("6", "5"): 40.0,
        ("2", "2"): 12.0, ("3", "3"): 13.0, ("4", "4"): 40.0, ("5", "5"): 40.0, ("6", "6"): 40.0,
    }


def test_of_overlapping_forecasts_the_newest_day_counts(spark, tmp_path):
    for issued, temperature in (("2024-07-02", 20.0), ("2024-07-03", 22.0)):
        day = {"day": {"avgtemp_c": temperature, "daily_will_it_rain": 0, "daily_chance_of_rain": 0, "condition": {"text": issued}}}
        write(tmp_path, f"weather/city=x/country=y/forecast_date={issued}/doc.json", {"forecast": {"forecastday": [day] * 3}})
    got = {str(r["forecast_date"]): r["temperature"] for r in docs.read_table(spark, str(tmp_path), "weather").collect()}
    assert got == {"2024-07-02": 20.0, "2024-07-03": 22.0, "2024-07-04": 22.0, "2024-07-05": 22.0}


def test_replaced_captures_read_their_documents_once(spark, sf_dir):
    """The newest capture is found beside the others."""
    from paceline.plans.queries import QUERIES

    plan = QUERIES["captures_replaced"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
