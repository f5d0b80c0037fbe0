"""Structured Streaming views of the event-driven parts. Each has a batch twin that gives the same rows at the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_once(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Append-only log without replays of a key within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def silence(events: DataFrame, by: str, at: str, gap: str = "45 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per session that a silence of `gap` ended: by, started, ended, n."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    each = stamped.groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n"), F.max(at).alias("ended"))
    return each.select(by, F.col("s.start").alias("started"), "ended", "n")


def rolling_factor(events: DataFrame, by: str, order: str, value: str, last: int = 10) -> DataFrame:
    """(by, factor) after each micro-batch: 1 + 0.2 x mean of the last values, kept as a ring of `last` per group."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Places stay beside the values, so that a late row takes its own place and can't push out a newer one.
        ring = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            ring += list(zip(pd.to_numeric(batch[order]).tolist(), batch[value].tolist()))
        ring = sorted(ring, key=lambda r: r[0])[-last:]
        state.update(([float(r[0]) for r in ring], [r[1] for r in ring]))
        known = [v for _, v in ring if v is not None and v == v]
        yield pd.DataFrame({by: [key[0]], "factor": [1 + 0.2 * (sum(known) / len(known) if known else 0.0)]})

    kind = dict(events.dtypes)[by]
    return events.select(by, order, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, factor double", "places array<double>, ring array<double>", "update", GroupStateTimeout.NoTimeout)


def import_batches(events: DataFrame, key: str, path: str, checkpoint: str):
    """A started query that appends each micro-batch once: keys that are there are left out, and a micro-batch that is
    replayed after a failure overwrites its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fresh = batch.dropDuplicates([key])
        if files.exists(root):
            known = spark.read.parquet(path).filter(F.col("batch") != number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cooldown(last_push, now, interval_minutes: int):
    """True where a new push is due."""
    return last_push.isNull() | (F.unix_micros(now) - F.unix_micros(last_push) >= interval_minutes * 60_000_000)


def pushes(events: DataFrame, by: str, at: str, interval: str) -> DataFrame:
    """(by, at) of the pushes that are let through: none within `interval` minutes (a column) after the last one of the same
    agent. The last push is the agent's state; rows that come late, before it, are held back too."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for micros, minutes in sorted(zip(batch["micros"].tolist(), batch[interval].tolist())):
                if last is None or micros - last >= minutes * 60_000_000:
                    last = micros
                    out.append((key[0], micros))
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=[by, "micros"])

    kind = dict(events.dtypes)[by]
    rows = events.filter(F.col(at).isNotNull()).select(by, F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), interval)
    let = rows.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, micros bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
    return let.select(by, F.timestamp_micros("micros").alias(at))


def record_states(events: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(record, owner, shared, epoch) after each micro-batch, as visibility.record_state folds it: each of the three is the event
    of the greatest sequence number so far, so that late events take their own place."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner_seq, owner, scope_seq, shared, epoch = state.get if state.exists else (0, None, 0, False, 0)
        for batch in batches:
            for seq, kind_, agent in zip(batch["event_seq"].tolist(), batch["event_kind"], batch["target_agent"]):
                if kind_ == "set_owner":
                    epoch = max(epoch, seq)
                    if seq > owner_seq:
                        owner_seq, owner = seq, agent
                elif kind_ in ("scope_private", "scope_shared"):
                    if kind_ == "scope_private":
                        epoch = max(epoch, seq)
                    if seq > scope_seq:
                        scope_seq, shared = seq, kind_ == "scope_shared"
        state.update((owner_seq, owner, scope_seq, shared, epoch))
        yield pd.DataFrame({"record": [key[0]], "owner": [owner or anchor], "shared": [shared], "epoch": [epoch]})

    kind = dict(events.dtypes)["record"]
    rows = events.select("record", "event_seq", "event_kind", "target_agent")
    return rows.groupBy("record").applyInPandasWithState(update, f"record {kind}, owner string, shared boolean, epoch bigint", "owner_seq bigint, owner string, scope_seq bigint, shared boolean, epoch bigint", "update", GroupStateTimeout.NoTimeout)
