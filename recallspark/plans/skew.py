"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.session import materialize

#: A key is hot if it has more than 1/HOT_SHARE of all rows; so there are never more than HOT_SHARE hot keys to broadcast.
HOT_SHARE = 1000
HOT_FLOOR = 50_000


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows inner join groups, where groups has one row per key and the number of rows of the key in `count`.

    Hot keys' groups are broadcast (at most HOT_SHARE rows, since their counts add up to total at most), so that their
    rows never meet in one task; all other keys are shuffled. Both parts together are the whole join.
    """
    line = max(HOT_FLOOR, total // HOT_SHARE)
    if total <= line:
        return rows.join(groups, on)
    hot = groups.filter(F.col(count) > line)
    cold = groups.filter(F.col(count) <= line)
    hot_rows = rows.join(F.broadcast(hot), on)
    cold_rows = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return hot_rows.unionByName(cold_rows)


def numbered(rows: DataFrame, per: list[str], order: list[str], name: str, floor: int = HOT_FLOOR) -> DataFrame:
    """rows with their place (from 1) in the order of each group; order must be total within a group.

    Groups of up to `floor` rows are each sorted by one task. If any is larger, all rows are sorted by ranges of (per, order), so
    that a group is cut into parts, each numbered by itself and moved on by the sizes of the parts before it.
    """
    largest = rows.groupBy(*per).count().agg(F.max("count")).first()[0] or 0
    if largest <= floor:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order)).cast("bigint"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    # Written, as ranges are drawn from samples and may change when a task runs again.
    cut = materialize(rows.repartitionByRange(parts, *per, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = cut.groupBy(*per, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select(*[F.col(c).alias(f"_{c}") for c in per], F.col("_part").alias("_p"), before.alias("_before"))
    within = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*per, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return within.join(moved, same).withColumn(name, (F.col("_k") + F.col("_before")).cast("bigint")).select(*rows.columns, name)
