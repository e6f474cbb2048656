"""Kept totals: what a new round has to know of all earlier ones.

A state holds a row per group: the sums over all its rows so far and its last few
rows.  A new round is worked on with the state alone, so its cost follows the round
and the groups, not the seasons behind them.  States of consecutive rounds merge into
the state of both.  Store one with ``sinks.publish``: a failure then leaves the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.windows import history_features, totals_as_of
from paceline.session import materialize

#: Shares of a group whose last rows are found apart before they meet.
SPREAD = 64


def _carried(order: list[str], form: dict[str, tuple[str, str]], totals: dict[str, str]) -> list[str]:
    return list(dict.fromkeys([*order, *totals.values(), *(column for _, column in form.values())]))


def fold(
    df: DataFrame, by: list[str], order: list[str], totals: dict[str, str], form: dict[str, tuple[str, str]], n: int = 5
) -> DataFrame:
    """The state of rows: ``by``, a sum per column of ``totals`` and ``last``, the last ``n`` rows in order.

    As in ``history_features``, ``order`` is unique within a group.
    """
    columns = _carried(order, form, totals)
    newest = [F.desc(c) for c in order]
    share = F.pmod(F.xxhash64(*order), F.lit(SPREAD)).alias("share")
    some = df.select(*by, *[c for c in columns if c not in by], share)
    some = some.withColumn("from_end", F.row_number().over(Window.partitionBy(*by, "share").orderBy(*newest))).filter(F.col("from_end") <= n)
    some = some.withColumn("from_end", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).filter(F.col("from_end") <= n)
    last = some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("last"))
    sums = df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{name}") for name, c in totals.items()])
    return sums.join(last, by)


def merge(earlier: DataFrame, later: DataFrame, by: list[str], totals: dict[str, str], n: int = 5) -> DataFrame:
    """The state of two rounds, the second of which has only rows after the first one's."""
    kept = F.array_sort(F.flatten(F.collect_list("last")))  # two short arrays at most
    rows = earlier.unionByName(later).groupBy(*by)
    merged = rows.agg(*[F.sum(f"all_{t}").alias(f"all_{t}") for t in totals], kept.alias("last"))
    return merged.withColumn("last", F.slice("last", F.greatest(F.size("last") - n + 1, F.lit(1)), F.lit(n)))


def advance(
    state: DataFrame, df: DataFrame, by: list[str], order: list[str], totals: dict[str, str], form: dict[str, tuple[str, str]], n: int = 5
) -> tuple[DataFrame, DataFrame]:
    """``df``'s rows, all after those of the state, with ``totals`` and ``form`` as ``history_features``
    gives them over everything so far; and the state that includes them."""
    columns = [c for c in _carried(order, form, totals) if c not in by]
    known = state.select(*by, F.explode("last").alias("row")).select(*by, *[F.col(f"row.{c}").alias(c) for c in columns])
    rows = df.withColumn("__new", F.lit(True)).unionByName(known.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    # Read twice, to be cut into segments.
    rows = materialize(rows, "round")
    worked = history_features(rows, by, order, totals, form, n).filter("__new").drop("__new")
    # The last rows are among those worked on; what lies before them is what they do not sum to.
    def in_last(name: str, c: str):
        kind = state.schema[f"all_{name}"].dataType
        return F.aggregate(F.col(f"last.{c}"), F.lit(0).cast(kind), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast(kind))

    opening = state.select(*by, *[(F.col(f"all_{name}") - in_last(name, c)).alias(f"__{name}") for name, c in totals.items()])
    out = worked.join(opening, by, "left").withColumns({t: F.col(t) + F.coalesce(F.col(f"__{t}"), F.lit(0)) for t in totals})
    return out.select(*df.columns, *totals, *form), merge(state, fold(df, by, order, totals, form, n), by, totals, n)


def fold_as_of(df: DataFrame, by: list[str], day: str, totals: dict[str, str]) -> DataFrame:
    """The state of totals that look at earlier days: sums over all days, the last day, and that day's own sums."""
    daily = df.groupBy(*by, day).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in totals.items()])
    return daily.groupBy(*by).agg(
        F.max(day).alias("last_day"),
        *[F.sum(t).alias(f"all_{t}") for t in totals],
        *[F.max_by(t, day).alias(f"last_{t}") for t in totals],
    )


def merge_as_of(earlier: DataFrame, later: DataFrame, by: list[str], totals: dict[str, str]) -> DataFrame:
    """The state of both; a day may be in the two of them."""
    rows = earlier.unionByName(later)
    last = rows.groupBy(*by).agg(F.max("last_day").alias("__day"))
    rows = rows.join(last, by)
    own = lambda t: F.sum(F.when(F.col("last_day") == F.col("__day"), F.col(f"last_{t}")))
    return rows.groupBy(*by).agg(
        F.max("last_day").alias("last_day"), *[F.sum(f"all_{t}").alias(f"all_{t}") for t in totals], *[own(t).alias(f"last_{t}") for t in totals]
    )


def advance_as_of(state: DataFrame, df: DataFrame, by: list[str], day: str, totals: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``df``'s rows, none before the state's last days, with ``totals`` over all strictly earlier days; and the new state.

    A round may go on with the day that the last one ended on.
    """
    worked = totals_as_of(df, by, day, totals).join(state, by, "left")
    # Rows of the state's last day do not see that day.
    before = {t: F.col(f"all_{t}") - F.when(F.col(day) == F.col("last_day"), F.col(f"last_{t}")).otherwise(F.lit(0)) for t in totals}
    out = worked.withColumns({t: F.col(t) + F.coalesce(b, F.lit(0)) for t, b in before.items()})
    return out.select(*df.columns, *totals), merge_as_of(state, fold_as_of(df, by, day, totals), by, totals)
