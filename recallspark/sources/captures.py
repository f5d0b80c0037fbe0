"""Browser captures: overlapping segments of one conversation put into one order, and a time for every message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.operators import timestamps
from recallspark.operators.context import time_ladder


def edges(messages: DataFrame, capture: str, segment: str, place: str, content_hash: str) -> DataFrame:
    """(capture, left, right, support): message pairs that follow each other within a segment, with the number of segments that
    say so; a pair stays only if its reverse has less than two thirds of its support (3 : 2 majority)."""
    ordered = messages.filter(F.col(content_hash).isNotNull()).groupBy(capture, segment).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(content_hash).alias("h")))).alias("run"))
    pairs = ordered.select(capture, F.explode(F.when(F.size("run") > 1, F.transform(F.sequence(F.lit(0), F.size("run") - 2), lambda i: F.struct(F.get("run", i)["h"].alias("left"), F.get("run", i + 1)["h"].alias("right"))))).alias("e"))
    counted = pairs.filter("e.left <> e.right").groupBy(capture, "e.left", "e.right").agg(F.count("*").alias("support"))
    back = counted.select(capture, F.col("left").alias("right"), F.col("right").alias("left"), F.col("support").alias("_against"))
    kept = counted.join(back, [capture, "left", "right"], "left").filter(F.col("_against").isNull() | (F.col("support") * 2 >= F.col("_against") * 3))
    return kept.drop("_against")


def unique_order(edge_rows: DataFrame, capture: str) -> DataFrame:
    """(capture, message, place) of captures whose edges allow exactly one order; ambiguous or cyclic ones give place -1.

    A capture is one export and bounded by it; captures are ordered independently, one group each.
    """
    kind = dict(edge_rows.dtypes)[capture]

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        following: dict[str, set] = {}
        waiting: dict[str, int] = {}
        for left, right in set(zip(rows["left"], rows["right"])):
            following.setdefault(left, set()).add(right)
            waiting[right] = waiting.get(right, 0) + 1
            waiting.setdefault(left, 0)
        free = [m for m, n in waiting.items() if n == 0]
        placed: list[str] = []
        single = True
        while free:
            single = single and len(free) == 1
            at = free.pop()
            placed.append(at)
            for right in following.get(at, ()):
                waiting[right] -= 1
                if waiting[right] == 0:
                    free.append(right)
        good = single and len(placed) == len(waiting)
        names = placed if good else sorted(waiting)
        return pd.DataFrame({capture: rows[capture].iloc[0], "message": names, "place": range(len(names)) if good else [-1] * len(names)})

    return edge_rows.groupBy(capture).applyInPandas(order, f"{capture} {kind}, message string, place int")


def message_times(messages: DataFrame) -> DataFrame:
    """(message_key, utc_micros, basis): the message's own time, else that of the next one in its capture as an upper bound, else
    null as observed."""
    timed = messages.select("message_key", "snapshot_id", "message_index", timestamps.utc_micros(F.col("created_at"), F.col("room_zone")).alias("own"), F.lit(None).cast("bigint").alias("observed"))
    return time_ladder(timed, ["snapshot_id"], ["message_index", "message_key"], "own", "observed").select("message_key", F.col("at").alias("utc_micros"), "basis")


def dominant_segment(messages: DataFrame, capture: str, segment: str, place: str, content_hash: str) -> DataFrame:
    """(capture, segment): the segment that holds all others of its capture in their order, -1 where none does or several longest
    ones differ. Rows without a hash don't count.

    A capture is one export; its segments' hashes are compared in one group per capture."""
    kind = dict(messages.dtypes)[capture]

    def within(needle: list, held: list) -> bool:
        at = iter(held)
        return all(value in at for value in needle)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        runs = {s: part.sort_values(["p", "h"])["h"].tolist() for s, part in rows.groupby("s")}
        whole = {s: run for s, run in runs.items() if all(within(other, run) for other in runs.values())}
        most = max(map(len, whole.values()), default=0)
        longest = sorted(s for s, run in whole.items() if len(run) == most)
        agreed = longest and all(whole[s] == whole[longest[0]] for s in longest)
        return pd.DataFrame({capture: rows[capture].iloc[:1], "segment": [int(longest[0]) if agreed else -1]})

    rows = messages.filter(F.col(content_hash).isNotNull() & F.col(segment).isNotNull()).select(capture, F.col(segment).cast("int").alias("s"), F.col(place).alias("p"), F.col(content_hash).alias("h"))
    return rows.groupBy(capture).applyInPandas(pick, f"{capture} {kind}, segment int")


def attested(messages: DataFrame, capture: str, place: str, content_hash: str) -> DataFrame:
    """(capture, problem): captures that can't be taken as complete: no_hash (a message without one), gap (places aren't
    consecutive), clash (two contents at one place)."""
    spots = messages.groupBy(capture, place).agg(F.count_distinct(content_hash).alias("contents"), F.count_if(F.col(content_hash).isNull()).alias("bare"))
    whole = spots.groupBy(capture).agg(F.sum("bare").alias("bare"), F.max("contents").alias("contents"), F.count(place).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    tests = {"no_hash": F.col("bare") > 0, "gap": F.col("high") - F.col("low") + 1 > F.col("n"), "clash": F.col("contents") > 1}
    found = F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda x: x.isNotNull())
    return whole.select(capture, F.explode(found).alias("problem"))
