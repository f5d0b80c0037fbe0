"""Record packages and chat exports to canonical records, and the sinks and ledger of imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.operators import timestamps
from recallspark.operators.dewey import explode_path
from recallspark.operators.hierarchy import forest

ROLES = ("system", "user", "assistant", "tool", "developer")
#: One record as packages state it. Positions of several branches come as an array.
RECORD = (
    "schema_version string, record_id string, source_kind string, source_ref string, conversation_id string, branch_id string, message_id string, role string, content string, "
    "created_at string, verified boolean, authority string, source_cutoff_at string, conflict_group_id string, branch_memberships array<struct<branch_id:string,position:int>>"
)
_REQUIRED = ("record_id", "source_kind", "source_ref", "conversation_id", "message_id", "role", "content", "created_at", "authority", "source_cutoff_at")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A package object with `records`, a bare array, or one record per file."""
    whole = spark.read.option("wholetext", True).text(path).select(F.ltrim(F.regexp_replace("value", "^\\x{FEFF}", "")).alias("value"))
    package = whole.select(F.from_json("value", f"schema_version string, records array<struct<{_ddl(RECORD)}>>").alias("p"), F.from_json("value", f"array<struct<{_ddl(RECORD)}>>").alias("a"), F.from_json("value", RECORD).alias("r"), "value")
    listed = F.when(F.col("value").startswith("["), F.col("a")).when(F.col("p.records").isNotNull(), F.transform("p.records", lambda r: r.withField("schema_version", F.coalesce(r["schema_version"], F.col("p.schema_version"))))).otherwise(F.array("r"))
    return package.select(F.explode(listed).alias("r")).select("r.*")


def _ddl(fields: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (part.split(" ", 1) for part in fields.split(", ")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; damaged lines keep their text in _corrupt."""
    return spark.read.schema(RECORD + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def errors(rows: DataFrame) -> DataFrame:
    """rows with errors, an array of what is wrong with each; nothing stops at the first."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    checks = [F.when(blank(c), F.lit(f"{c}: missing")) for c in _REQUIRED]
    checks.append(F.when(F.col("role").isNotNull() & ~F.trim("role").isin(*ROLES), F.lit("role: unknown")))
    checks += [F.when(~blank(c) & timestamps.utc_micros(F.col(c)).isNull(), F.lit(f"{c}: no instant")) for c in ("created_at", "source_cutoff_at")]
    checks.append(F.when(F.col("verified").isNull(), F.lit("verified: missing")))
    checks.append(F.when(F.col("branch_id").isNull() & (F.size(F.coalesce("branch_memberships", F.array())) == 0), F.lit("branch: missing")))
    checks.append(F.when(F.exists(F.coalesce("branch_memberships", F.array()), lambda m: m["position"].isNull() | (m["position"] < 0)), F.lit("position: negative or missing")))
    return rows.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def canonical(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, memberships) of rows without errors. Equal records merge their memberships; one position per branch, a
    stated one before none. Content stays verbatim."""
    names = [c for c in _REQUIRED if c not in ("content", "created_at", "source_cutoff_at")]
    clean = rows.select(*[F.trim(c).alias(c) for c in names], "content", "verified", F.trim("conflict_group_id").alias("conflict_group_id"), F.timestamp_micros(timestamps.utc_micros(F.col("created_at"))).alias("created_at"), F.timestamp_micros(timestamps.utc_micros(F.col("source_cutoff_at"))).alias("source_cutoff_at"), F.sha2("content", 256).alias("content_sha256"), _memberships().alias("m"))
    memberships = clean.select("record_id", F.explode("m").alias("m")).groupBy("record_id", "m.branch_id").agg(F.max("m.position").alias("position"))
    first = memberships.groupBy("record_id").agg(F.min("branch_id").alias("branch_id"))
    return clean.drop("m").dropDuplicates(["record_id", "content_sha256"]).join(first, "record_id"), memberships


def _memberships() -> Column:
    single = F.array(F.struct(F.trim("branch_id").alias("branch_id"), F.lit(None).cast("int").alias("position")))
    return F.when(F.size(F.coalesce("branch_memberships", F.array())) > 0, F.col("branch_memberships")).otherwise(single)


def conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose id is known with another content."""
    known = existing.select("record_id", F.col("content_sha256").alias("_known"))
    within = new.groupBy("record_id").agg(F.count_distinct("content_sha256").alias("_n")).filter("_n > 1").select("record_id")
    return new.join(known, "record_id").filter(F.col("_known") != F.col("content_sha256")).select("record_id").unionByName(within).distinct()


def append(new: DataFrame, path: str, batch_id: str) -> int:
    """Append the records whose id isn't there yet, as one batch folder; a batch that is there already is a replay and adds
    nothing. Returns the number added.

    An id that comes with two contents, within the batch or against the store, stops the batch (where content_sha256 is
    given); rows that repeat are added once."""
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        return 0
    root = jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if files.exists(root) and len([f for f in files.listStatus(root) if f.getPath().getName() != f"batch={batch_id}"]) else None
    if known is not None:
        known = known.filter(F.col("batch").cast("string") != batch_id)
    if "content_sha256" in new.columns:
        clash = conflicts(new, known if known is not None else new.limit(0)).count()
        if clash:
            raise ValueError(f"{clash} record ids come with another content")
    fresh = new.dropDuplicates(["record_id"])
    if known is not None:
        fresh = fresh.join(known.select("record_id"), "record_id", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return spark.read.parquet(f"{path}/batch={batch_id}").count()


def write_package(records: DataFrame, path: str) -> None:
    """One JSON record per line; refuses to overwrite."""
    records.select(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def preflight(rows: DataFrame) -> DataFrame:
    """Counts only: no content leaves the report."""
    checked = errors(rows)
    return checked.agg(F.count("*").alias("n_records"), F.count_if(F.size("errors") > 0).alias("n_errors"), F.count_distinct("conversation_id").alias("n_conversations"), F.count_if("verified").alias("n_verified"))


# Exports -----------------------------------------------------------------------------------------------------------------


def tree_backup_messages(backups: DataFrame) -> DataFrame:
    """Messages of tree backups with their place on the path to the conversation's current leaf, counted from 0 at the root.

    Hidden nodes keep their place. Messages off that path have position null; those whose chain never ends too.
    """
    said = explode_path(backups, "backup_id", "data", ["messages"]).select("backup_id", F.col("node.conversationId").alias("cid"), F.col("node.sourceMessageId").alias("mid"), F.col("node.parentSourceMessageId").alias("parent"), F.col("node.role").alias("role"), F.col("node.createdAt").alias("created_ms"), part_text(F.col("node.contentParts")).alias("content"))
    leaf = explode_path(backups, "backup_id", "data", ["conversations"]).select("backup_id", F.col("node.id").alias("cid"), F.col("node.currentLeafSourceMessageId").alias("leaf"))
    placed = forest(said.select(F.struct("backup_id", "cid").alias("tree"), "mid", "parent"), "tree", "mid", "parent")
    # A node is on the path to a leaf if the leaf's entry lies between its own entry and exit, within one root.
    ends = leaf.select(F.struct("backup_id", "cid").alias("tree"), "leaf").join(placed.filter("depth >= 0").select("tree", F.col("node").alias("leaf"), F.col("root").alias("_root"), F.col("entry").alias("_at")), ["tree", "leaf"]).select("tree", "_root", "_at").distinct()
    above = placed.filter("depth >= 0").join(ends, "tree").filter((F.col("root") == F.col("_root")) & (F.col("_at") >= F.col("entry")) & (F.col("_at") < F.col("exit")))
    depth = above.select("tree", F.col("node").alias("mid"), "depth").distinct()
    return said.join(depth.select("tree.backup_id", "tree.cid", "mid", F.col("depth").alias("position")), ["backup_id", "cid", "mid"], "left")


def part_text(parts: Column) -> Column:
    """Content parts as one text: their texts, and a mark for each that has none."""
    return F.array_join(F.transform(F.coalesce(parts, F.array()), lambda p: F.coalesce(p["text"], F.concat(F.lit("["), F.coalesce(p["type"], F.lit("unknown")), F.lit("]")))), "\n")


def rollout_messages(snapshots: DataFrame) -> DataFrame:
    """User and agent messages of rollout snapshots in order; all other items are left out."""
    from recallspark.operators.dewey import PARTS, valid_json

    kind = "array<struct<id:string,turns:array<struct<id:string,status:string,items:array<struct<id:string,type:string,text:string,phase:string,content:string>>>>>>"
    parsed = snapshots.select("snapshot_id", F.from_json(valid_json(F.col("threads")), kind).alias("threads"))
    items = explode_path(parsed, "snapshot_id", "threads", ["", "turns", "items"], {"0": {"thread_id": "id"}, "1": {"turn_id": "id"}})
    asked = F.array_join(F.transform(F.filter(F.from_json("node.content", PARTS), lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
    kept = items.filter(F.col("node.type").isin("userMessage", "agentMessage"))
    return kept.select("snapshot_id", "thread_id", "turn_id", "label", F.col("node.id").alias("message_id"), F.when(F.col("node.type") == "userMessage", "user").otherwise("assistant").alias("role"), F.when(F.col("node.type") == "userMessage", asked).otherwise(F.col("node.text")).alias("content"), F.col("node.phase").alias("phase"))


def zip_shards(spark: SparkSession, path: str) -> DataFrame:
    """(archive, shard, conversations) of ZIP exports: the JSON text of each shard named in the manifest, else of every
    conversations*.json. Archives are read whole by one task each."""
    import io
    import json
    import zipfile

    import pandas as pd

    def unpack(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = set(archive.namelist())
                    wanted = sorted(n for n in names if n.rsplit("/", 1)[-1].startswith("conversations") and n.endswith(".json"))
                    for manifest in (n for n in names if n.endswith("manifest.json")):
                        listed = json.loads(archive.read(manifest)).get("logical_files", {}).get("conversations.json", {}).get("files", [])
                        wanted = [n for n in listed if n in names] or wanted
                    rows += [(name, shard, archive.read(shard).decode("utf-8-sig")) for shard in wanted]
            yield pd.DataFrame(rows, columns=["archive", "shard", "conversations"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, shard string, conversations string")


def membership_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(record_id, branch_id, position, known) of new memberships that state another position than the store's. A position
    that one of the sides doesn't state is no conflict; null ids meet nothing."""
    known = existing.select("record_id", "branch_id", F.col("position").alias("known")).distinct()
    return new.select("record_id", "branch_id", "position").distinct().join(known, ["record_id", "branch_id"]).filter(F.col("position") != F.col("known"))
