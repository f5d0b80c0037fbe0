"""Neighbours by branch position, event windows, phase bundles and clock ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per cell of a range join. A window reaches at most two neighbouring cells.
CELL = 64


def window_join(hits: DataFrame, memberships: DataFrame, before: int, after: int, own: bool = False) -> DataFrame:
    """(branch_id, position, hit, near, near_position): the memberships at position - before .. position + after of each
    hit's branch.

    hits and memberships: record_rowid, branch_id, position. Positions may have gaps. The join is on branch and cell of
    positions, so that a branch with a third of all rows is spread over tasks; the range is what remains to test. Null
    positions have no neighbours. Without own the hit itself is left out.
    """
    reach = F.sequence(F.floor(F.greatest(F.col("position") - before, F.lit(0)) / CELL), F.floor((F.col("position") + after) / CELL))
    left = hits.filter(F.col("position").isNotNull()).select("branch_id", "position", F.col("record_rowid").alias("hit"), F.explode(reach).alias("cell"))
    right = memberships.filter(F.col("position").isNotNull()).select("branch_id", F.floor(F.col("position") / CELL).alias("cell"), F.col("record_rowid").alias("near"), F.col("position").alias("near_position"))
    joined = left.join(right, ["branch_id", "cell"])
    kept = joined.filter((F.col("near_position") >= F.col("position") - before) & (F.col("near_position") <= F.col("position") + after))
    kept = kept if own else kept.filter(F.col("near") != F.col("hit"))
    return kept.select("branch_id", "position", "hit", "near", "near_position").distinct()


def nearest_final(rows: DataFrame, reach: int = 4) -> DataFrame:
    """(id, final_id, distance): each process row's nearest final row of its conversation and branch, at most `reach` after it,
    with no user turn between; the nearest first, then the smaller id. Rows without one are left out.

    rows: id, conversation_id, branch_id, position, role, phase ('final_answer', or another for process rows).
    """
    key = ["conversation_id", "branch_id"]
    cell = F.floor(F.col("position") / CELL)
    process = rows.filter(F.col("phase").isNotNull() & (F.col("phase") != "final_answer")).select(*key, "id", "position", F.explode(F.array_distinct(F.array(cell, F.floor((F.col("position") + reach) / CELL)))).alias("cell"))
    final = rows.filter(F.col("phase") == "final_answer").select(*key, cell.alias("cell"), F.col("id").alias("final_id"), F.col("position").alias("final_position"))
    asked = rows.filter(F.lower(F.trim("role")) == "user").select(*key, cell.alias("cell"), F.col("position").alias("asked_position"))
    pairs = process.join(final, [*key, "cell"]).filter((F.col("final_position") > F.col("position")) & (F.col("final_position") <= F.col("position") + reach)).select(*key, "id", "position", "final_id", "final_position").distinct()
    spans = pairs.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("position") / CELL), F.floor(F.col("final_position") / CELL)))))
    cut = spans.join(asked, [*key, "cell"]).filter((F.col("asked_position") > F.col("position")) & (F.col("asked_position") < F.col("final_position"))).select("id", "final_id").distinct()
    open_ = pairs.join(cut, ["id", "final_id"], "left_anti").withColumn("distance", F.col("final_position") - F.col("position"))
    best = open_.groupBy("id").agg(F.min(F.struct("distance", "final_id")).alias("b"))
    return best.select("id", F.col("b.final_id").alias("final_id"), F.col("b.distance").alias("distance"))


def first_last(rows: DataFrame, per: list[str], order: list[str], first: int = 6, last: int = 6, keep: Column | None = None) -> DataFrame:
    """The first and last rows of each group in order, and all rows that keep marks.

    Each end is a limit of its own, which is pushed below its sort, so that no task holds more of a group than its ends; the
    group's size, counted map-side, keeps a row that lies at both ends from coming twice. order is total within a group."""
    up = Window.partitionBy(*per).orderBy(*[F.col(c).asc() for c in order])
    down = Window.partitionBy(*per).orderBy(*[F.col(c).desc() for c in order])
    marked = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    sizes = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in per]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    head = rows.withColumn("_k", F.row_number().over(up)).filter(F.col("_k") <= first)
    tail = rows.withColumn("_k", F.row_number().over(down)).filter(F.col("_k") <= last).join(sizes, same).filter(F.col("_k") <= F.col("_n") - first)
    ends = head.select(*rows.columns).unionByName(tail.select(*rows.columns))
    if keep is None:
        return ends
    # What lies between the ends and is marked: those marked that aren't among the ends.
    here = ends.select(*[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*per, *order])]).distinct()
    equal = F.lit(True)
    for c in dict.fromkeys([*per, *order]):
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ends.unionByName(rows.filter(marked).join(here, equal, "left_anti"))


def time_ladder(rows: DataFrame, per: list[str], order: list[str], stamp: str, observed: str) -> DataFrame:
    """rows with at and basis: the row's own stamp, else the next stamp in order as an upper bound, else the time observed."""
    ahead = Window.partitionBy(*per).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    following = F.first(stamp, ignorenulls=True).over(ahead)
    basis = F.when(F.col(stamp).isNotNull(), "own").when(following.isNotNull(), "next").otherwise("observed")
    return rows.withColumns({"at": F.coalesce(F.col(stamp), following, F.col(observed)), "basis": basis})


def monotonic_breaks(rows: DataFrame, per: list[str], order: list[str], stamp: str) -> DataFrame:
    """Per group the number of stamps earlier than the one before."""
    known = rows.filter(F.col(stamp).isNotNull())
    back = F.lag(stamp).over(Window.partitionBy(*per).orderBy(*order)) > F.col(stamp)
    return known.select(*per, F.coalesce(back, F.lit(False)).alias("_back")).groupBy(*per).agg(F.sum(F.col("_back").cast("bigint")).alias("breaks"))


def event_windows(rows: DataFrame, anchor: Column, participation: Column, excluded: Column, before: int = 6, after: int = 4) -> DataFrame:
    """(branch_id, hit, n_rows, n_event_rows, first_event): windows around anchor rows that hold an event row.

    rows: record_rowid, branch_id, position and what the three conditions read. An event row has an anchor term and a sign
    of participation and no reason of exclusion. The representative is the earliest event row by position, then id.

    A window is made of its positions, of which each is counted once: where a branch has many rows at one position, hits and
    rows aren't paired. Hits of one position share their window.
    """
    judged = rows.filter(F.col("position").isNotNull()).select("record_rowid", "branch_id", "position", F.coalesce(anchor, F.lit(False)).alias("anchor"), (F.coalesce(anchor & participation, F.lit(False)) & ~F.coalesce(excluded, F.lit(False))).alias("event"))
    places = judged.groupBy("branch_id", F.col("position").cast("bigint").alias("place")).agg(F.count("*").alias("n"), F.sum(F.col("event").cast("bigint")).alias("events"), F.min(F.when(F.col("event"), F.struct("position", F.col("record_rowid").alias("near")))).alias("first"))
    hits = judged.filter("anchor").select("branch_id", F.col("record_rowid").alias("hit"), "position").distinct()
    wanted = hits.select("branch_id", "position").distinct()
    around = wanted.withColumn("place", F.explode(F.sequence(F.col("position").cast("bigint") - before, F.col("position").cast("bigint") + after)))
    windows = around.join(places, ["branch_id", "place"]).groupBy("branch_id", "position").agg(F.sum("n").alias("n_rows"), F.sum("events").alias("n_event_rows"), F.min("first").alias("first")).filter(F.col("n_event_rows") > 0)
    return hits.join(windows, ["branch_id", "position"]).select("branch_id", "hit", "position", "n_rows", "n_event_rows", F.col("first.near").alias("first_event"))


def capped(near: DataFrame, cap: int, per: tuple[str, ...] = ("branch_id", "position", "hit")) -> DataFrame:
    """window_join rows with place, of each hit the `cap` nearest ones: by distance, the earlier side first, then by key. The cap is
    the context that a hit is shown with; the window itself stays whole."""
    order = [F.abs(F.col("near_position") - F.col("position")).asc(), F.col("near_position").asc(), F.col("near").asc()]
    return near.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("place") <= cap)
