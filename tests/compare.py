"""Runs a query and its SQL twin and compares rows, columns and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, [tuple(_value(row[n]) for n in names) for row in df.collect()]


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [
        tuple(_value(row[i]) for i in order) for row in cursor.fetchall()
    ]


def difference(df, con, sql) -> str | None:
    names, got = rows_of_spark(df)
    wanted_names, wanted = rows_of_sql(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, SQL has {len(wanted)}"
    if not got:
        return None
    for i, name in enumerate(names):
        kinds = {type(r[i]) for r in got if r[i] is not None}
        wanted_kinds = {type(r[i]) for r in wanted if r[i] is not None}
        if kinds != wanted_kinds:
            return f"{name}: {kinds} != {wanted_kinds}"
    left, right = Counter(got), Counter(wanted)
    if left != right:
        only, missing = left - right, right - left
        return f"{sum(only.values())} rows differ: {list(only)[:2]} / {list(missing)[:2]}"
    return None
