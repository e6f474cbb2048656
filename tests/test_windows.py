"""Running totals and form: by hand, and against plain loops."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from paceline.functions.scalars import win_flag
from paceline.operators.segments import ordered_segments, spanning_groups
from paceline.operators.windows import form_carried_over, history_features, totals_as_of

FORM = {"form_avg": ("avg", "points"), "form_finish": ("avg", "finish"), "form_wins": ("sum", "win")}


@pytest.fixture(scope="module")
def toy(spark):
    rows = [
        ("a", "x", "2021-01-01", 10, 1),
        ("a", "x", "2021-02-01", 20, None),
        ("a", "x", "2021-03-01", 30, 3),
        ("b", "x", "2021-01-01", 1, None),
        ("b", "x", "2021-02-01", 2, 5),
        ("b", "x", "2021-03-01", 3, 6),
    ]
    df = spark.createDataFrame(rows, "driver string, team string, day string, points int, finish int")
    return df.withColumns({"day": F.to_date("day"), "win": win_flag(F.col("finish"))})


def values(df, column):
    return [r[column] for r in df.orderBy("driver", "day").collect()]


def test_driver_totals_and_form_by_hand(toy):
    out = history_features(toy, ["driver"], ["day"], {"before": "points"}, FORM)
    assert values(out, "before") == [0, 10, 30, 0, 1, 3]
    assert values(out, "form_avg") == [None, 10, 15, None, 1, 1.5]
    assert values(out, "form_finish") == [None, 1, 1, None, None, 5]


def test_form_that_leaks_over_drivers_by_hand(toy):
    out = form_carried_over(toy, ["driver"], ["day"], FORM, totals={"before": "points"})
    assert values(out, "form_avg") == [None, 10, 15, 20, 1, 1.5]
    assert values(out, "before") == [0, 10, 30, 0, 1, 3]


def test_team_totals_in_driver_order_by_hand(toy):
    out = history_features(toy, ["team"], ["driver", "day"], {"t": "points"})
    assert values(out, "t") == [0, 10, 30, 60, 61, 63]


def test_team_totals_as_of_the_day_by_hand(toy):
    out = totals_as_of(toy, ["team"], "day", {"t": "points"})
    assert values(out, "t") == [0, 11, 33, 0, 11, 33]


@pytest.fixture(scope="module")
def skewed(spark):
    """One driver holds a third of the rows, many hold a few."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        driver = 0 if rng.random() < 0.34 else rng.randrange(1, 200)
        finish = rng.choice([None, 1, 2, 3, 4])
        rows.append((driver, rng.randrange(40), i, rng.randrange(50), finish))
    df = spark.createDataFrame(rows, "driver int, day int, id int, points int, finish int")
    return df.withColumn("win", win_flag(F.col("finish"))).repartition(5)


def of_window(rows, kind):
    kept = [x for x in rows if x is not None]
    if not kept:
        return None
    return sum(kept) / len(kept) if kind == "avg" else sum(kept)


def by_loop(df, n):
    """{id: (before, wins, form, leaking form)}, one row after the other in (driver, day, id) order."""
    out, driver, handed = {}, None, dict.fromkeys(FORM)
    for r in sorted(df.collect(), key=lambda r: (r["driver"], r["day"], r["id"])):
        if r["driver"] != driver:
            driver, points, wins = r["driver"], 0, 0
            last = {name: deque(maxlen=n) for name in FORM}
        form = {name: of_window(last[name], kind) for name, (kind, _) in FORM.items()}
        out[r["id"]] = (points, wins, form, handed)
        points, wins = points + r["points"], wins + r["win"]
        for name, (_, column) in FORM.items():
            last[name].append(r[column])
        handed = {name: of_window(last[name], kind) for name, (kind, _) in FORM.items()}
    return out


@pytest.mark.parametrize("n", [1, 5])
def test_history_equals_a_loop(skewed, n):
    wanted = by_loop(skewed, n)
    got = history_features(skewed, ["driver"], ["day", "id"], {"before": "points", "wins": "win"}, FORM, n).collect()
    assert len(got) == len(wanted)
    for r in got:
        before, wins, form, _ = wanted[r["id"]]
        assert (r["before"], r["wins"]) == (before, wins)
        assert {name: r[name] for name in FORM} == pytest.approx(form)


@pytest.mark.parametrize("n", [1, 5])
def test_carried_form_equals_a_loop(skewed, n):
    wanted = by_loop(skewed, n)
    for r in form_carried_over(skewed, ["driver"], ["day", "id"], FORM, n).collect():
        assert {name: r[name] for name in FORM} == pytest.approx(wanted[r["id"]][3])


def test_a_hot_group_is_spread_and_few_groups_span(skewed):
    segmented = ordered_segments(skewed, ["driver", "day", "id"])
    sizes = [r["count"] for r in segmented.groupBy("seg").count().collect()]
    assert skewed.filter("driver = 0").count() > 450
    assert max(sizes) < 450
    assert spanning_groups(segmented, ["driver"]).count() < len(sizes)


@pytest.mark.parametrize("cuts", [(10,), (1, 2, 25), (0, 20)])
def test_kept_state_and_rounds_equal_a_recomputation(spark, cuts):
    import random

    from paceline.operators import kept

    r = random.Random(3)
    rows = [(r.choice("aaabc") if i < 30 else r.choice("ad"), i, r.choice([None, r.randrange(9)]), float(r.randrange(5))) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, at int, x bigint, y double")
    args = (["g"], ["at"], {"sum_x": "x"}, {"avg_y": ("avg", "y"), "sum_last": ("sum", "x")})
    whole = {(w["g"], w["at"]): tuple(w) for w in history_features(df, *args, n=3).collect()}
    edges = [*cuts, 40]
    state = kept.fold(df.filter(F.col("at") < edges[0]), *args, n=3)
    days = kept.fold_as_of(df.filter(F.col("at") < edges[0]), ["g"], "at", {"sum_x": "x"})
    for lo, hi in zip(edges, edges[1:], strict=False):
        new = df.filter((F.col("at") >= lo) & (F.col("at") < hi))
        out, state = kept.advance(state, new, *args, n=3)
        got = {(w["g"], w["at"]): tuple(w) for w in out.collect()}
        assert got == {k: v for k, v in whole.items() if lo <= k[1] < hi}
        out, days = kept.advance_as_of(days, new, ["g"], "at", {"sum_x": "x"})
        assert {(w["g"], w["at"]): w["sum_x"] for w in out.collect()} == {k: v[4] for k, v in whole.items() if lo <= k[1] < hi}
    end = kept.fold(df, *args, n=3)
    assert sorted(map(tuple, state.select(*end.columns).collect())) == sorted(map(tuple, end.collect()))


def test_totals_within_a_further_column_need_no_second_order(spark):
    """Drivers of several teams, more segments than drivers: the same totals as in an order of their own."""
    from paceline.operators.windows import form_carried_over, history_features
    from paceline.plans import matrices

    rows = [(d, (d * 7 + i // 9) % 3, i, (i * d) % 11, int(i % 4 == 0), i % 6) for d in range(1, 5) for i in range(60)]
    df = spark.createDataFrame(rows, "driver_id int, constructor_id int, at int, points int, win int, finish int")
    got = form_carried_over(
        df, ["driver_id"], ["at"], matrices.FORM_COLUMNS, totals=matrices.DRIVER_TOTALS, within={"constructor_id": matrices.TEAM_TOTALS}
    ).select("driver_id", "at", *matrices.TEAM_TOTALS)
    want = history_features(df, ["constructor_id"], ["driver_id", "at"], matrices.TEAM_TOTALS).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_matrix_writes_each_row_twice_at_most(spark, sf_dir, monkeypatch):
    """Results, and their segments: no copy of either for a reader that a matrix does not have, nor row keys in them."""
    from paceline import session
    from paceline.operators import segments, windows
    from paceline.plans import jobs, matrices, queries, star

    written, write = [], session.materialize
    for module in (segments, windows, jobs, matrices, star):
        monkeypatch.setattr(module, "materialize", lambda df, name, **k: written.append((name, df.columns)) or write(df, name, **k))
    for variant, segment in (("faithful", "carried"), ("corrected", "history")):
        written.clear()
        queries._train(spark, sf_dir, variant)
        assert [name for name, _ in written if name not in ("members", "totals_as_of")] == ["results", segment]
        assert all("row_key" not in columns for _, columns in written)
