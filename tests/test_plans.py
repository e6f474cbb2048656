"""The physical plans are the ones meant."""

import re

import pytest

from paceline.plans import star
from paceline.plans.queries import QUERIES


def plan_text(df):
    """The plan as run, so that what was decided while running is in it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final(text):
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "name",
    ["circuit_stats", "circuit_stats_asof", "season_so_far", "winner_per_season"],
)
def test_the_season_range_reaches_the_scan(spark, sf_dir, name):
    text = plan_text(QUERIES[name](spark, sf_dir))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "o_orderdate" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan_text(QUERIES["circuit_stats"](spark, sf_dir))
    schema = next(
        m for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in m
    )
    assert "l_shipdate" not in schema and "l_extendedprice" not in schema


@pytest.mark.parametrize("name", ["driver_totals_before", "form_last5", "form_last5_faithful"])
def test_no_window_takes_the_whole_table_through_one_task(spark, sf_dir, name):
    text = final(plan_text(QUERIES[name](spark, sf_dir)))
    lines = text.splitlines()
    gathered = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    # All that is ever put in one order is one row per segment.
    assert all(any("Sort [seg#" in line for line in lines[max(0, i - 5) : i]) for i in gathered)


@pytest.mark.parametrize(
    "name, most",
    [("score_matrix", 2), ("history_qualifying_left", 1), ("history_qualifying_fallback", 1), ("entry_list_semi", 1), ("entry_list_semi_empty", 1), ("qualifying_left", 1)],
)
def test_the_fact_is_scanned_once(spark, sf_dir, name, most, monkeypatch):
    read, scans = star.read, []
    monkeypatch.setattr(star, "read", lambda s, d, t: scans.append(t) or read(s, d, t))
    for cached in (star.races, star.drivers, star.results):
        cached.cache_clear()
    QUERIES[name](spark, sf_dir).collect()
    assert scans.count("lineitem") <= most


def test_team_totals_as_of_sort_days_not_rows(spark, sf_dir):
    text = final(plan_text(QUERIES["team_totals_before_asof"](spark, sf_dir)))
    above_scan = text[: text.index("Window")]
    assert "HashAggregate" in text[text.index("Window") :] and "Window" not in above_scan


@pytest.mark.parametrize(
    "name",
    [
        "standings_circuit_left",
        "history_qualifying_left",
        "entry_list_semi",
        "weather_default_join",
        "race_day_forecast",
        "circuit_stats_asof",
        "driver_history",
        "form_last5_faithful",
        "score_matrix",
    ],
)
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    text = plan_text(QUERIES[name](spark, sf_dir))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert unwanted not in text


def test_winners_are_reduced_before_the_shuffle(spark, sf_dir):
    text = final(plan_text(QUERIES["winner_per_circuit"](spark, sf_dir)))
    assert "partial_min" in text


def test_last_races_are_a_top_n(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_text(QUERIES["last_n_races"](spark, sf_dir))


def test_dimensions_too_large_are_not_broadcast(spark, sf_dir):
    """Broadcasts of dimensions are Spark's choice by size, not forced."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(star.history_results(spark, sf_dir))
        assert "BroadcastHashJoin" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
