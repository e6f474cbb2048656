"""Running totals and trailing form, each looking only at earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.segments import ordered_segments, spanning_groups
from paceline.session import materialize

FORM_FUNCTIONS = {"avg": F.avg, "sum": F.sum}


def _running_sum(value: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def _form(form: dict, window) -> list[Column]:
    return [
        FORM_FUNCTIONS[kind](F.col(column)).over(window).alias(name)
        for name, (kind, column) in form.items()
    ]


def history_features(
    df: DataFrame,
    by: list[str],
    order: list[str],
    totals: dict[str, str],
    form: dict[str, tuple[str, str]] | None = None,
    n: int = 5,
) -> DataFrame:
    """Totals before each row and form over the ``n`` rows before it.

    ``totals`` maps a new column to the column it sums over all earlier rows of
    the group (0 at its start); ``form`` maps a new column to ("avg" | "sum",
    column), NULL while nothing came before.  ``order`` must be unique within a
    group.  Rows are worked on in segments of (group, order), so a group may
    have any size; ``df`` is read twice, to find the borders and to be cut there.
    """
    form = form or {}
    segmented = ordered_segments(df, [*by, *order], "history")
    with_halo, spanning = _with_halo(segmented, by, order, form, n)
    piece = Window.partitionBy("seg", *by).orderBy(*order)
    rows = with_halo.select(
        "*", *_totals_in_piece(totals, piece), *_form(form, piece.rowsBetween(-n, -1))
    ).filter(~F.col("halo"))
    rows = _add_openings(rows, segmented, spanning, by, totals)
    return rows.select(*df.columns, *totals, *form)


def _totals_in_piece(totals: dict, piece) -> list[Column]:
    """Running totals inside a group's part of a segment, halo rows left out."""
    return [
        _running_sum(F.when(~F.col("halo"), F.col(c)), piece).alias(name)
        for name, c in totals.items()
    ]


def _add_openings(rows, segmented, spanning, by, totals) -> DataFrame:
    """Add to each running total what the group's earlier segments sum to.

    Only groups in several segments have openings; with n segments that makes
    fewer than 2n rows, so they are broadcast.
    """
    if not totals:
        return rows
    earlier = Window.partitionBy(*by).orderBy("seg")
    opening = (
        segmented.join(F.broadcast(spanning), by, "left_semi")
        .groupBy(*by, "seg")
        .agg(*[F.sum(c).alias(name) for name, c in totals.items()])
        .select(
            *by, "seg", *[_running_sum(F.col(t), earlier).alias(f"{t}_opening") for t in totals]
        )
    )
    return rows.join(F.broadcast(opening), [*by, "seg"], "left").withColumns(
        {t: F.col(t) + F.coalesce(F.col(f"{t}_opening"), F.lit(0)) for t in totals}
    )


def _with_halo(segmented, by, order, form, n) -> tuple[DataFrame, DataFrame]:
    """Segment rows plus, flagged ``halo``, the ``n`` group rows before each."""
    spanning = spanning_groups(segmented, by)
    marked = segmented.withColumn("halo", F.lit(False))
    if not form:
        return marked, spanning
    carried = list(dict.fromkeys([*order, *[column for _, column in form.values()]]))
    newest = Window.partitionBy("seg", *by).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        segmented.join(F.broadcast(spanning), by, "left_semi")
        .withColumn("from_end", F.row_number().over(newest))
        .filter(F.col("from_end") <= n)
        .groupBy(*by, "seg")
        .agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("tail"))
    )
    earlier = Window.partitionBy(*by).orderBy("seg").rowsBetween(-n, -1)
    before = F.flatten(F.collect_list("tail").over(earlier))
    halo = (
        tails.select(*by, "seg", before.alias("before"))
        .select(
            *by,
            "seg",
            F.explode(
                F.slice("before", F.greatest(F.size("before") - n + 1, F.lit(1)), n)
            ).alias("row"),
        )
        .select(*by, "seg", *[F.col(f"row.{c}").alias(c) for c in carried if c not in by])
        .withColumn("halo", F.lit(True))
    )
    return marked.unionByName(halo, allowMissingColumns=True), spanning


def form_carried_over(
    df: DataFrame,
    by: list[str],
    order: list[str],
    form: dict[str, tuple[str, str]],
    n: int = 5,
    totals: dict[str, str] | None = None,
    within: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Form that leaks over group borders, as the original computes it.

    Each row gets the rolling value (its last ``n`` rows, its own included) of
    the row before it in (group, order), so a group's first row receives the
    value of the *previous group's* last row.  ``totals`` are those of
    ``history_features``, computed in the same pass.  ``within`` maps a further column to
    totals over its groups in the order (by, order), as ``history_features`` gives them for
    [column] and [*by, *order]: what its members in ``by`` before this one sum to, plus
    this one's own total so far, so that the rows need no second order.

    The lag runs inside segments of (group, order); each segment's last value is
    handed to the next, which is one row per segment.
    """
    totals = totals or {}
    segmented = ordered_segments(df, [*by, *order], "carried")
    with_halo, spanning = _with_halo(segmented, by, order, form, n - 1)
    piece = Window.partitionBy("seg", *by).orderBy(*order)
    # Partitioned by segment alone, which serves both windows; the second then
    # finds the rows sorted as it needs them.
    rolled = (
        with_halo.repartition("seg")
        .select(
            "*",
            *_totals_in_piece(totals, piece),
            *[
                total
                for column, sums in (within or {}).items()
                for total in _totals_in_piece(sums, Window.partitionBy("seg", *by, column).orderBy(*order))
            ],
            F.struct(*_form(form, piece.rowsBetween(1 - n, 0))).alias("rolled"),
        )
        .filter(~F.col("halo"))
    )
    # A segment hands on the rolling value of its last row, which takes that row's
    # group among the segment's last n rows.  One row per segment results; their
    # count is the number of range partitions.
    backwards = Window.partitionBy("seg").orderBy(*[F.col(c).desc() for c in [*by, *order]])
    last = (
        with_halo.withColumn("from_end", F.row_number().over(backwards))
        .filter(F.col("from_end") <= n)
        .groupBy("seg", *by)
        .agg(
            F.min("from_end").alias("from_end"),
            *[FORM_FUNCTIONS[kind](column).alias(name) for name, (kind, column) in form.items()],
        )
        .filter("from_end = 1")
        .select("seg", F.struct(*form).alias("rolled_last"))
    )
    handed = last.select("seg", F.lag("rolled_last").over(Window.orderBy("seg")).alias("handed"))
    whole = Window.partitionBy("seg").orderBy(*by, *order)
    rows = (
        rolled.withColumn("nth", F.row_number().over(whole))
        .withColumn("previous", F.lag("rolled").over(whole))
        .join(F.broadcast(handed), "seg", "left")
        .withColumn(
            "given", F.when(F.col("nth") == 1, F.col("handed")).otherwise(F.col("previous"))
        )
    )
    rows = _add_openings(rows, segmented, spanning, by, totals)
    for column, sums in (within or {}).items():
        # A group of both may span segments only where its members' group does.
        rows = _add_openings(rows, segmented, spanning_groups(segmented, [*by, column]), [*by, column], sums)
        rows = _add_members_before(rows, df, by, column, sums)
    return rows.select(
        *df.columns,
        *totals,
        *[name for sums in (within or {}).values() for name in sums],
        *[F.col(f"given.{name}").alias(name) for name in form],
    )


def _add_members_before(rows: DataFrame, df: DataFrame, by: list[str], column: str, sums: dict[str, str]) -> DataFrame:
    """Add to each total what the members before this one in its group of ``column`` sum to.

    A row per member, written so that its size picks the join.
    """
    keys = [column, *by]
    members = df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = Window.partitionBy(column).orderBy(*by)
    members = members.select(
        *[F.col(c).alias(f"__{c}") for c in keys],
        *[_running_sum(F.col(name), before).alias(f"{name}_members") for name in sums],
    )
    members = materialize(members, "members")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(members, same, "left").withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"{name}_members"), F.lit(0)) for name in sums}
    )


def totals_as_of(df: DataFrame, by: list[str], day: str, totals: dict[str, str]) -> DataFrame:
    """Totals over all rows of the group on strictly earlier days.

    Summed to (group, day) first, so the window sees one row per calendar day
    and no row-level sort takes place.
    """
    daily = df.groupBy(*by, day).agg(*[F.sum(c).alias(name) for name, c in totals.items()])
    window = Window.partitionBy(*by).orderBy(day)
    opening = daily.select(
        *by, day, *[_running_sum(F.col(name), window).alias(name) for name in totals]
    )
    return df.join(opening, [*by, day])
