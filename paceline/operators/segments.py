"""Ordered work over groups of any size.

A window holds a whole group in one task.  Groups here may be too large for
that, so rows are range-partitioned by (group, order): a group then
spreads over consecutive *segments*, each about one n-th of all rows whatever
the key distribution, and only what crosses a segment's border is carried over.

A border between two segments can cut through one group at most, so with n
segments there are at most n - 1 groups that need anything carried, and fewer
than 2n (group, segment) pairs they make up.  That bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import materialize

def ordered_segments(df: DataFrame, order: list[str], name: str = "segments") -> DataFrame:
    """``df`` with ``seg``, the number of its range partition in ``order``.

    Written out, because a range partitioning is sampled anew in each run and
    the segment numbers have to stay what they are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("seg", F.spark_partition_id())
    return materialize(ranged, name)


def spanning_groups(segmented: DataFrame, by: list[str]) -> DataFrame:
    """Groups that lie in more than one segment: fewer than there are segments."""
    return (
        segmented.groupBy(*by)
        .agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg"))
        .filter("first_seg < last_seg")
        .select(*by)
    )
