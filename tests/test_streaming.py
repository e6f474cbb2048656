"""A second run reads only what is new."""

import json

from paceline.streaming.landing import captures_of, compact, ingest_new, ingested, quarantine_of, rejects_of


def document(*drivers, day="2023-03-05"):
    race = {"raceName": "R", "date": day, "Circuit": {"circuitId": "c"}, "Results": [one(d) for d in drivers]}
    return json.dumps({"MRData": {"RaceTable": {"Races": [race]}}})


def one(driver):
    return {
        "grid": "1",
        "position": "1",
        "points": "25",
        "status": "Finished",
        "Driver": {"driverId": driver, "givenName": driver, "familyName": "Smith"},
        "Constructor": {"constructorId": "red", "name": "Red"},
    }


def test_ingest_new(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")

    def capture(round_, text, name="doc.json"):
        folder = landing / f"results/season=2023/round={round_}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def run():
        query = ingest_new(spark, str(landing), "results", table, str(tmp_path / "progress"))
        query.awaitTermination()
        assert query.exception() is None
        return sorted(r["driver_id"] for r in ingested(spark, table, "results").collect())

    capture(1, document("ann"))
    capture(2, '{"broken')
    assert run() == ["ann"]
    assert run() == ["ann"]
    capture(3, document("bob"))
    assert run() == ["ann", "bob"]
    # Several documents in a file, and one of an earlier file once more.
    capture(3, "\n".join([document("bob"), document("cat"), document("dan")]), "more.json")
    capture(4, document("eva") + "\n" + document("fay"), "all.jsonl")
    assert run() == ["ann", "bob", "cat", "dan", "eva", "fay"]
    assert [r["unreadable"] for r in spark.read.parquet(quarantine_of(table)).collect()] == ['{"broken']


def test_a_new_capture_replaces_rows_and_a_replayed_batch_adds_none(spark, tmp_path):
    landing, table, progress = tmp_path / "landing", str(tmp_path / "table"), tmp_path / "progress"

    def run(*captures):
        for round_, name, text in captures:
            folder = landing / f"results/season=2023/round={round_}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(text)
        query = ingest_new(spark, str(landing), "results", table, str(progress))
        query.awaitTermination()
        assert query.exception() is None
        got = ingested(spark, table, "results").select("round", "driver_id", "race_date").collect()
        return sorted((r["round"], r["driver_id"], str(r["race_date"])[-2:]) for r in got)

    assert run((1, "a.json", document("x", "y", "z")), (2, "a.json", document("x"))) == [(1, "x", "05"), (1, "y", "05"), (1, "z", "05"), (2, "x", "05")]
    assert run((1, "b.json", document("x", "y", day="2023-03-06"))) == [(1, "x", "06"), (1, "y", "06"), (2, "x", "05")]
    # A capture without a row, one that can't be read, a row without its key.
    assert run((2, "b.json", document()), (1, "c.json", "{"), (3, "a.json", document("w", None))) == [(1, "x", "06"), (1, "y", "06"), (3, "w", "05")]
    assert [r["reasons"] for r in spark.read.parquet(rejects_of(table)).collect()] == [["no driver_id"]]
    files, listed = spark.read.parquet(table).count(), spark.read.parquet(captures_of(table)).count()
    # The last batch's commit is lost, so it runs again.
    last = max(int(p.name) for p in (progress / "commits").iterdir() if p.name.isdigit())
    for mark in (progress / "commits").iterdir():
        if mark.name.strip(".").startswith(str(last)):
            mark.unlink()
    assert run() == [(1, "x", "06"), (1, "y", "06"), (3, "w", "05")]
    assert (spark.read.parquet(table).count(), spark.read.parquet(captures_of(table)).count()) == (files, listed)
    compact(spark, table, "results", str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3
