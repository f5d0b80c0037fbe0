"""Exports in detail: conversations of ZIP archives with folded reasoning and paths, and the checks of tree backups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.functions.text import reference
from recallspark.operators.dewey import explode_path, valid_json
from recallspark.operators.hierarchy import forest

#: What is read of a conversation. Structured parts come as their JSON text.
CONVERSATIONS = (
    "array<struct<id:string,conversation_id:string,title:string,current_node:string,mapping:map<string,struct<parent:string,message:struct<id:string,author:struct<role:string>,create_time:double,"
    "content:struct<content_type:string,parts:array<string>,text:string,content:string,thoughts:array<struct<summary:string,content:string,chunks:array<string>>>>>>>>>"
)
#: Content types of folded reasoning, which are phases too.
FOLDED = ("thoughts", "reasoning_recap")


def _said(content: Column) -> Column:
    """The text of a message: its parts by line, a mark for each structured one; folded reasoning by its thoughts."""
    kind = F.get_json_object
    part = lambda p: F.when(p.startswith("{"), F.concat(F.lit("["), F.coalesce(kind(p, "$.content_type"), F.lit("unknown")), F.lit("]"))).otherwise(p)
    parts = F.array_join(F.filter(F.transform(F.coalesce(content["parts"], F.array().cast("array<string>")), part), lambda p: F.length(p) > 0), "\n")
    lines = lambda t: F.array_join(F.array_distinct(F.filter(F.concat(F.array(t["summary"], t["content"]), F.coalesce(t["chunks"], F.array().cast("array<string>"))), lambda v: F.length(F.trim(v)) > 0)), "\n")
    thoughts = F.array_join(F.filter(F.transform(F.coalesce(content["thoughts"], F.array().cast("array<struct<summary:string,content:string,chunks:array<string>>>")), lines), lambda v: F.length(v) > 0), "\n\n")
    return F.when(content["content_type"] == "thoughts", thoughts).when(content["content_type"] == "reasoning_recap", content["content"]).otherwise(F.coalesce(F.nullif(parts, F.lit("")), content["text"], F.lit("")))


def zip_messages(shards: DataFrame) -> DataFrame:
    """The messages of ZIP exports (archive, shard, conversations), one row each: archive, conversation_id, node, parent, message_id,
    role, content, phase, created_at, on_path, position, source_ref.

    Messages of users and assistants with any text count. phase: thoughts or reasoning_recap for folded reasoning, else null.
    on_path: on the way from the root to the conversation's current node; position counts the messages on it from 0, null off
    it. Damaged shards and conversations without a known current node have no path. A tree is one conversation of one archive.
    """
    parsed = shards.select("archive", F.explode(F.from_json(valid_json(F.col("conversations")), CONVERSATIONS)).alias("c"))
    nodes = parsed.select("archive", F.coalesce("c.conversation_id", "c.id").alias("conversation_id"), F.col("c.current_node").alias("leaf"), F.explode("c.mapping").alias("node", "n"))
    tree = F.struct("archive", "conversation_id")
    placed = forest(nodes.select(tree.alias("tree"), "node", F.col("n.parent").alias("parent")), "tree", "node", "parent").filter("depth >= 0")
    leaves = nodes.select(tree.alias("tree"), F.col("leaf").alias("node")).distinct().join(placed.select("tree", "node", F.col("root").alias("_root"), F.col("entry").alias("_at")), ["tree", "node"]).select("tree", "_root", "_at")
    path = placed.join(leaves, "tree").filter((F.col("root") == F.col("_root")) & F.col("_at").between(F.col("entry"), F.col("exit") - 1)).select("tree.archive", "tree.conversation_id", "node", "depth")
    message, role = F.col("n.message"), F.lower(F.col("n.message.author.role"))
    kind = F.col("n.message.content.content_type")
    said = nodes.select("archive", "conversation_id", "node", F.col("n.parent").alias("parent"), message["id"].alias("message_id"), role.alias("role"), _said(message["content"]).alias("content"), F.when(kind.isin(*FOLDED), kind).alias("phase"), F.timestamp_micros(F.floor(message["create_time"] * 1_000_000).cast("bigint")).alias("created_at"))
    kept = said.filter(F.col("role").isin("user", "assistant") & (F.length(F.trim("content")) > 0)).join(path, ["archive", "conversation_id", "node"], "left")
    on_path = F.col("depth").isNotNull()
    # A conversation is one JSON value and as bounded as that.
    place = F.row_number().over(Window.partitionBy("archive", "conversation_id", on_path).orderBy("depth")) - 1
    return kept.withColumns({"on_path": on_path, "position": F.when(on_path, place), "source_ref": reference("zip", F.col("conversation_id"), message=F.col("message_id"), phase=F.col("phase"))}).drop("depth")


# Tree backups ----------------------------------------------------------------------------------------------------------------


def number_text(value: int | float) -> str:
    """A number as a browser writes it: the shortest digits that read back, plain from 1e-7 up to 1e21, else with an exponent."""
    if isinstance(value, int):
        return str(value)
    if value == 0:
        return "0"
    sign, digits, shift = Decimal(repr(value)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + shift
    if len(text) <= point <= 21:
        out = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def dump(value: object) -> str:
    """JSON text as a browser's serialiser writes it: fields in their order, no blanks, no escapes beyond the needed ones."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)


def backup_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, state, declared, actual, data): backup files with their checksum over `data`.

    state: valid, mismatch, unsupported (another algorithm, or no checksum) or damaged (no JSON object with data). data is the
    JSON text of the field. One file is read by one task."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    whole = json.loads(content.decode("utf-8-sig"))
                    data = whole["data"]
                except (ValueError, KeyError, TypeError):
                    rows.append((name, "damaged", None, None, None))
                    continue
                declared, text = whole.get("checksum"), dump(data)
                actual = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                supported = whole.get("checksumAlgorithm") == "SHA-256" and isinstance(declared, str)
                rows.append((name, "unsupported" if not supported else "valid" if declared.lower() == actual else "mismatch", declared if isinstance(declared, str) else None, actual, text))
            yield pd.DataFrame(rows, columns=["file", "state", "declared", "actual", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(check, "file string, state string, declared string, actual string, data string")


def backup_problems(backups: DataFrame) -> DataFrame:
    """(backup_id, conversation_id, problem, n) of tree backups: what is wrong with each conversation's tree.

    unlisted_conversation: messages of a conversation that isn't listed; repeated_message: rows beyond the first of one
    sourceMessageId; missing_parent: a parent that isn't there; endless_chain; unknown_leaf: the current leaf isn't there.
    """
    key = ["backup_id", "conversation_id"]
    said = explode_path(backups, "backup_id", "data", ["messages"]).select("backup_id", F.col("node.conversationId").alias("conversation_id"), F.col("node.sourceMessageId").alias("mid"), F.col("node.parentSourceMessageId").alias("parent"))
    listed = explode_path(backups, "backup_id", "data", ["conversations"]).select("backup_id", F.col("node.id").alias("conversation_id"), F.col("node.currentLeafSourceMessageId").alias("leaf"))
    count = lambda rows, name: rows.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.lit(name).alias("problem"), "n")
    known = said.filter(F.col("mid").isNotNull()).select(*key, "mid").distinct()
    repeated = said.filter(F.col("mid").isNotNull()).groupBy(*key, "mid").agg((F.count("*") - 1).alias("more")).groupBy(*key).agg(F.sum("more").alias("n")).filter("n > 0").select(*key, F.lit("repeated_message").alias("problem"), "n")
    placed = forest(said.select(F.struct(*key).alias("tree"), "mid", "parent"), "tree", "mid", "parent")
    lost = placed.filter((F.col("depth") == 0) & F.col("parent").isNotNull()).select("tree.*")
    parts = [
        count(said.join(listed.select(*key).distinct(), key, "left_anti"), "unlisted_conversation"), repeated, count(lost, "missing_parent"), count(placed.filter("depth = -1").select("tree.*"), "endless_chain"),
        count(listed.filter(F.col("leaf").isNotNull()).withColumnRenamed("leaf", "mid").join(known, [*key, "mid"], "left_anti"), "unknown_leaf"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
