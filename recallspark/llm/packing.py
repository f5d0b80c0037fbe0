"""Items into containers of fixed capacity, with the sources' shares controlled by deficit round-robin."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.tokens import VOCABULARY, token_count
from recallspark.session import materialize

#: Containers that one task group fills, about. The group is the unit of work: a few MB of (id, size) pairs.
CONTAINERS_PER_GROUP = 2000


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(item, source, size): only these three go on, no text is shuffled. Null texts have size 0, null sources ''."""
    return documents.select(F.col(key).alias("item"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(token_count(F.col(text), path), F.lit(0)).alias("size"))


def pack(items: DataFrame, capacity: int = 2048, shares: dict[str, float] | None = None, containers_per_group: int = CONTAINERS_PER_GROUP) -> DataFrame:
    """Every item's container: item, piece, source, size, container.

    items: item, source, size. Items of more than the capacity are cut: full pieces get containers of their own and the
    rest is packed like an item; no other item is cut. Items of size 0 or null join a container and take no room; a
    null source is a source, a null item is left out. Items that repeat are packed each.
    shares: target share of the tokens per source, by default the shares found; no item is dropped to reach them, the
    order of filling only spreads the sources as evenly as they last.

    Items are spread over groups by hash, so that one source with a third of all rows is in all groups alike. The
    difference between a source's tokens and its share of a group's tokens is its deficit; running sums over the groups
    carry it from each group to the next, and within a group it goes from each container to the next.
    """
    spark = items.sparkSession
    measured = items.filter(F.col("item").isNotNull()).select("item", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
    measured = materialize(measured, "packing-items")
    total = measured.agg(F.sum("size")).first()[0] or 0
    groups = max(1, round(total / capacity / containers_per_group))
    spread = measured.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    # One row per group and source; a source's deficits are summed over the groups before.
    tokens = spread.groupBy("grp", "source").agg(F.sum("size").alias("tokens"))
    if shares is None:
        target = tokens.groupBy("source").agg((F.sum("tokens") / F.lit(max(total, 1))).alias("share"))
    else:
        target = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, share double")
    of_group = tokens.groupBy("grp").agg(F.sum("tokens").alias("all"))
    short = tokens.join(of_group, "grp").join(target, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    carried = short.withColumn("carried", F.coalesce(F.sum(F.col("share") * F.col("all") - F.col("tokens")).over(before), F.lit(0.0))).select("grp", "source", "share", "carried")
    joined = spread.join(carried, ["grp", "source"])

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _fill(int(key[0]), rows, capacity)

    # As many partitions as groups, as the few bytes of a group would otherwise put all of them into one task.
    return joined.repartition(groups, "grp").groupBy("grp").applyInPandas(fill, "item bigint, piece int, source string, size bigint, container string")


def _fill(group: int, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Deficit round-robin over source queues, each sorted by size so that the largest item that fits is found at once."""
    out: list[tuple] = []
    queues: dict[str, list[tuple[int, int, int]]] = {}
    deficit: dict[str, float] = {}
    share: dict[str, float] = {}
    opened = 0
    for row in rows.sort_values(["source", "item"]).itertuples(index=False):
        queue = queues.setdefault(row.source, [])
        share[row.source], deficit[row.source] = row.share, deficit.get(row.source, row.carried)
        size, piece = int(row.size), 0
        while size > capacity:
            out.append((row.item, piece, row.source, capacity, f"{group}-{opened}"))
            size, piece, opened = size - capacity, piece + 1, opened + 1
        queue.append((size, int(row.item), piece))
    for queue in queues.values():
        queue.sort()
    while any(queues.values()):
        name = f"{group}-{opened}"
        live = [s for s, q in queues.items() if q]
        scale = sum(share[s] for s in live) or len(live)
        for s in live:
            deficit[s] += capacity * (share[s] or (1.0 if scale == len(live) else 0.0)) / scale
        room = capacity
        first = True
        while True:
            # The source that is most behind takes its turn; one that has no fitting item passes.
            best = None
            for s in live:
                queue = queues[s]
                if queue and queue[0][0] <= room and (best is None or deficit[s] > deficit[best]):
                    best = s
            if best is None:
                break
            queue = queues[best]
            at = bisect_right(queue, (room, 1 << 62, 0)) - 1
            if not first and len(live) > 1 and queue[at][0] < room:
                # Near the end of a container a fuller fit counts for more than the turn.
                for s in live:
                    k = bisect_right(queues[s], (room, 1 << 62, 0)) - 1
                    if k >= 0 and queues[s][k][0] == room:
                        best, queue, at = s, queues[s], k
                        break
            size, item, piece = queue.pop(at)
            deficit[best] -= size
            room -= size
            first = False
            out.append((item, piece, best, size, name))
        opened += 1
    return pd.DataFrame(out, columns=["item", "piece", "source", "size", "container"])


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, mean fill."""
    each = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.avg(F.col("used") / capacity), 6).alias("mean_fill"))


def mixture_report(packed: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """How well the containers keep the sources' shares: source, target, share, deviation.

    target: the share given for the source, by default its share of all tokens; share: its share of all tokens; deviation:
    mean over all containers that hold any tokens of the distance between its share of the container and the target.
    Sources without tokens have no row."""
    used = packed.filter(F.col("size") > 0).groupBy("container", "source").agg(F.sum("size").alias("part"))
    whole = used.groupBy("container").agg(F.sum("part").alias("whole"))
    total, containers = whole.agg(F.sum("whole"), F.count("*")).first()
    of_source = used.groupBy("source").agg((F.sum("part") / F.lit(total or 1)).alias("share"))
    if shares is None:
        target = of_source.withColumn("target", F.col("share"))
    else:
        given = packed.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, target double")
        target = of_source.join(given, "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    apart = used.join(whole, "container").join(target, "source").groupBy("source", "target", "share").agg(F.sum(F.abs(F.col("part") / F.col("whole") - F.col("target"))).alias("sum"), F.count("*").alias("n"))
    # Containers without the source are off by the whole target.
    return apart.select("source", F.round("target", 6).alias("target"), F.round("share", 6).alias("share"), F.round((F.col("sum") + (F.lit(containers) - F.col("n")) * F.col("target")) / F.lit(max(containers, 1)), 6).alias("deviation"))
