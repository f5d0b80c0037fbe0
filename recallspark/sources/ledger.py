"""The ledger of import batches: what was taken in, from which inputs, and how far a batch got."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.sources import packages

_SCHEMA = "batch_id string, inputs string, n bigint, state string, seq int"


class BatchConflict(ValueError):
    """A batch of the same name was registered with other inputs."""


def batch_id(name: str, source: str) -> str:
    """batch- and 24 hex digits of the SHA-256 of name and source as a compact JSON array."""
    return "batch-" + hashlib.sha256(json.dumps([name, source], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:24]


def inputs_hash(records: DataFrame) -> tuple[str, int]:
    """A hash of the set of (record_id, content_sha256), the same in any order, and the number of rows: one aggregation."""
    mod = F.lit((1 << 61) - 1)
    parts = [F.sum(F.xxhash64(F.lit(seed), "record_id", "content_sha256").bitwiseAND(mod).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    row = records.agg(*parts, F.count("*").alias("n")).first()
    return hashlib.sha256(f"{row['h1']}:{row['h2']}:{row['n']}".encode()).hexdigest(), row["n"]


class Ledger:
    """An append-only table of states under a shared folder, beside the records it tells of: registered, then done or failed.

    Writers come one at a time; a batch that is registered and not done is resumed by importing it again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All states, in any order. Empty where nothing was registered."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(str(root))

    def batches(self) -> DataFrame:
        """(batch_id, inputs, n, state): the last state of each batch."""
        return self.rows().groupBy("batch_id").agg(F.max_by(F.struct("inputs", "n", "state"), "seq").alias("l")).select("batch_id", "l.*")

    def _state(self, batch: str) -> dict | None:
        row = self.batches().filter(F.col("batch_id") == batch).first()
        return row.asDict() if row else None

    def _add(self, batch: str, inputs: str, n: int, state: str) -> None:
        seq = self.rows().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        self.spark.createDataFrame([(batch, inputs, n, state, seq)], _SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def register(self, name: str, source: str, records: DataFrame) -> tuple[str, str]:
        """(batch id, what to do): new, resume (registered or failed before) or replay (done before). BatchConflict where the
        batch was registered with other inputs."""
        batch = batch_id(name, source)
        inputs, n = inputs_hash(records)
        known = self._state(batch)
        if known is None:
            self._add(batch, inputs, n, "registered")
            return batch, "new"
        if known["inputs"] != inputs:
            raise BatchConflict(f"{batch} was registered with other inputs")
        return batch, "replay" if known["state"] == "done" else "resume"

    def take_in(self, name: str, source: str, records: DataFrame, progress: Callable[[str, int], None] | None = None) -> dict:
        """Registers and appends the records (record_id, content_sha256, ...); the counts added and skipped.

        A replay adds nothing; a batch whose run broke is taken in again from its start, over what the broken run left.
        progress is called with each state and its number of rows. Records whose id is known with another content stop the
        batch, which is then marked failed."""
        tell = progress or (lambda state, n: None)
        batch, todo = self.register(name, source, records)
        n = records.count()
        tell("registered", n)
        if todo == "replay":
            return {"batch_id": batch, "status": "replay", "added": 0, "skipped": n}
        inputs, _ = inputs_hash(records)
        try:
            added = packages.append(records, f"{self.path}/records", batch)
        except Exception:
            self._add(batch, inputs, n, "failed")
            tell("failed", n)
            raise
        self._add(batch, inputs, n, "done")
        tell("done", added)
        return {"batch_id": batch, "status": todo, "added": added, "skipped": n - added}


def import_history(spark: SparkSession, path: str, store: str, owner: str = "anchor") -> dict:
    """Takes a package file (JSON or JSONL) into a store under its own name, with an owner for each record. Rows with errors are
    counted and left out; the same file again is a replay."""
    rows = packages.errors(packages.read_jsonl(spark, path) if path.endswith(".jsonl") else packages.read_json(spark, path))
    good = rows.filter(F.size("errors") == 0)
    records, _ = packages.canonical(good.drop("errors", "_corrupt"))
    done = Ledger(spark, store).take_in(path.rsplit("/", 1)[-1], "history", records.withColumn("owner", F.lit(owner)))
    return done | {"failed": rows.filter(F.size("errors") > 0).count()}


# Adapters ------------------------------------------------------------------------------------------------------------------


def inspect(rows: DataFrame) -> dict:
    """Counts of a source's canonical rows, without any content."""
    return packages.preflight(rows).first().asDict()


def dry_run(rows: DataFrame, existing: DataFrame | None = None) -> dict:
    """What a conversion would do: counts, the rows with errors, and the ids that clash with existing records."""
    checked = packages.errors(rows)
    good, _ = packages.canonical(checked.filter(F.size("errors") == 0).drop("errors"))
    clash = packages.conflicts(good, existing if existing is not None else good.limit(0)).count()
    return inspect(rows) | {"n_good": good.count(), "n_conflicts": clash}


def convert(rows: DataFrame) -> DataFrame:
    """The canonical records of rows that have no errors."""
    return packages.canonical(packages.errors(rows).filter(F.size("errors") == 0).drop("errors"))[0]


def write(rows: DataFrame, path: str) -> int:
    """Converts and writes a package; refuses to overwrite. The number of records."""
    records = convert(rows)
    packages.write_package(records, path)
    return records.count()
