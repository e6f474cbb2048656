"""Tables written to the shared folder."""

import os
import time

from pyspark.sql import functions as F

from paceline import session


def tables(spark):
    folder = session._own_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def written(spark):
    return {n.rsplit("-", 1)[0] for n in tables(spark)}


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with session.scratch(spark):
        inner = session.materialize(spark.range(5), "scratch_inner")
        with session.scratch(spark):
            session.materialize(spark.range(2), "scratch_deeper")
        assert "scratch_inner" in written(spark) and "scratch_deeper" not in written(spark)
        result = session.materialize(inner.filter("id > 1"), "scratch_result", keep=True)
    assert "scratch_inner" not in written(spark)
    assert result.count() == 3
    assert session.materialize(spark.range(1), "scratch_after").count() == 1 and "scratch_after" in written(spark)


def shuffled(spark):
    """Bytes of the shuffle files that lie on this machine's disks."""
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(os.path.join(root, f)) for d in top for root, _, files in os.walk(d) for f in files if f.startswith("shuffle_"))


def test_what_is_shuffled_for_a_table_goes_once_it_is_written(spark):
    before = shuffled(spark)
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), "id").repartition(5, "key")
    table = session.materialize(rows, "shuffled_once")
    for _ in range(50):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before and table.count() == 200_000
    assert spark.conf.get(session.SHUFFLES_DELETED) == "false"


def test_a_kept_table_goes_with_the_scope_around_its_own(spark):
    with session.scratch(spark):
        with session.scratch(spark):
            table = session.materialize(spark.range(3), "scratch_handed", keep=True)
        assert table.count() == 3 and "scratch_handed" in written(spark)
    assert "scratch_handed" not in written(spark)
