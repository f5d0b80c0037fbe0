"""Duplicates hidden by formatting: commutative fingerprints of name-value pairs, then a check of field equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.text import content_keys, same_pairs
from recallspark.plans.skew import join_counted
from recallspark.session import materialize

_KEY = ["kind", "h1", "h2"]


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first): for every row whose content equals that of a row with smaller key, the smallest such key.

    Fingerprints are counted with map-side aggregation, so that a content with a third of all rows is one small group;
    only members of groups of two or more are shuffled with their pairs, against their group's first row. Keys are
    unique; rows with a null key and null and blank contents never count. Texts are read whole.
    """
    total = df.count()
    keys = content_keys(df, key, text)
    groups = keys.groupBy(*_KEY).agg(F.min("key").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    groups = materialize(groups, "copies-groups")
    members = materialize(join_counted(keys, groups, _KEY, "n", 2 * total), "copies-members")
    firsts = members.filter(F.col("key") == F.col("first")).select(*_KEY, F.col("pairs").alias("first_pairs"), F.col("n").alias("size"))
    others = members.filter(F.col("key") != F.col("first")).drop("n")
    checked = join_counted(others, firsts, _KEY, "size", 2 * total).filter(same_pairs(F.col("pairs"), F.col("first_pairs")))
    return checked.groupBy("key").agg(F.min("first").alias("first"))


def collapse(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row of df per content, the one with the smallest key, with n_copies. Rows with null or blank content stay, with
    n_copies 1."""
    dup = classes(df, key, text)
    counts = dup.groupBy("first").agg((F.count("*") + 1).alias("_n")).withColumnRenamed("first", "_first")
    kept = df.join(dup.select(F.col("key").alias("_dup")), F.col(key) == F.col("_dup"), "left_anti")
    return kept.join(counts, F.col(key) == F.col("_first"), "left").withColumn("n_copies", F.coalesce("_n", F.lit(1))).drop("_first", "_n")


def found(records: DataFrame) -> DataFrame:
    return classes(records, "id", "content").select(F.col("first").cast("bigint").alias("first_id"), F.col("key").cast("bigint").alias("dup_id"))
