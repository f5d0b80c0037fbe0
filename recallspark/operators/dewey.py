"""Deeply nested records to related flat tables by Dewey labels.

Every array element gets an ordinal path label such as '0.3.2' (third thread part ... counted from 0 at each level). A
child's parent label is its own label without the last ordinal, so that no surrogate keys or windows are needed; link()
finds the parent node by it. Nodes are grouped by schema path; each path of array-of-struct fields is one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.session import materialize


def parent_label(label: Column) -> Column:
    """The label without its last ordinal; '' for a node of the top level."""
    return F.regexp_replace(label, r"(^|\.)\d+$", "")


def valid_json(text: Column) -> Column:
    """text where it is complete JSON, else null. Blank, null, cut-off and damaged texts give null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _arrays(schema: T.StructType) -> dict[str, T.StructType]:
    """The fields that are arrays of structs, through plain structs."""
    found = {}
    for field in schema.fields:
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            found[field.name] = field.dataType.elementType
        elif isinstance(field.dataType, T.StructType):
            found |= {f"{field.name}.{name}": kind for name, kind in _arrays(field.dataType).items()}
    return found


def schema_paths(kind: T.DataType, prefix: str = "") -> dict[str, T.StructType]:
    """Every path of array-of-struct fields below a type, with the element's type."""
    if isinstance(kind, T.ArrayType):
        return ({prefix or "$": kind.elementType} if isinstance(kind.elementType, T.StructType) else {}) | schema_paths(kind.elementType, prefix or "$")
    if not isinstance(kind, T.StructType):
        return {}
    found = {}
    for name, element in _arrays(kind).items():
        path = f"{prefix}.{name}" if prefix else name
        found |= {path: element} | schema_paths(element, path)
    return found


def _get(value: Column, dotted: str) -> Column:
    for name in dotted.split("."):
        value = value[name]
    return value


def explode_path(df: DataFrame, row_key: str, root: str, path: list[str], keep: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One row per node at the end of a path of array fields below the column root ('' in path: root itself is the array).

    Result: row_key, label, parent_label, node (struct), and for each level named in keep the listed fields of that
    ancestor. Null structs, null and empty arrays and null elements give no rows. Other columns of df are not carried,
    so that names can't clash.
    """
    keep = keep or {}
    out = df.select(F.col(row_key).alias("_row"), F.col(root).alias("_at"), F.lit("").alias("_label"))
    carried: list[str] = []
    for depth, name in enumerate(path):
        source = F.col("_at") if name == "" else _get(F.col("_at"), name)
        out = out.select("_row", "_label", *carried, F.posexplode(source).alias("_pos", "_node")).filter(F.col("_node").isNotNull())
        wanted = keep.get(str(depth), {})
        label = F.concat_ws(".", F.nullif(F.col("_label"), F.lit("")), F.col("_pos").cast("string"))
        out = out.select("_row", label.alias("_label"), F.col("_node").alias("_at"), *carried, *[_get(F.col("_node"), field).alias(alias) for alias, field in wanted.items()])
        carried += list(wanted)
    return out.select(F.col("_row").alias(row_key), F.col("_label").alias("label"), parent_label(F.col("_label")).alias("parent_label"), F.col("_at").alias("node"), *carried)


def shred(df: DataFrame, row_key: str, root: str) -> dict[str, DataFrame]:
    """All tables of a nested column: schema path -> (row_key, label, parent_label, the element's flat fields).

    Works for any depth of the declared type. Fields that are themselves arrays of structs go to their own table;
    plain structs are flattened with '_' between names; a clash with the three key columns gets the prefix 'f_'.
    """
    kind = df.schema[root].dataType
    tables = {}
    for path, element in schema_paths(kind).items():
        steps = _steps(kind, path)
        nodes = explode_path(df, row_key, root, steps)
        flat = []
        for name, column in _flat_fields(element, F.col("node")):
            flat.append(column.alias(f"f_{name}" if name in (row_key, "label", "parent_label") else name))
        tables[path] = nodes.select(row_key, "label", "parent_label", *flat)
    return tables


def _steps(kind: T.DataType, path: str) -> list[str]:
    """The array fields passed on the way to a schema path; a name may be dotted through plain structs."""
    steps: list[str] = []
    rest = path
    if isinstance(kind, T.ArrayType):
        steps, rest, kind = [""], path.removeprefix("$").removeprefix("."), kind.elementType
    while rest:
        name, element = next((n, e) for n, e in sorted(_arrays(kind).items(), key=lambda x: -len(x[0])) if rest == n or rest.startswith(n + "."))
        steps.append(name)
        rest, kind = rest[len(name) :].removeprefix("."), element
    return steps


def _flat_fields(kind: T.StructType, at: Column, prefix: str = "") -> list[tuple[str, Column]]:
    found: list[tuple[str, Column]] = []
    for field in kind.fields:
        value, inner = at[field.name], field.dataType
        if isinstance(inner, T.StructType):
            found += _flat_fields(inner, value, f"{prefix}{field.name}_")
        elif not (isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType)):
            found.append((prefix + field.name, value))
    return found


def link(children: DataFrame, parents: DataFrame, row_key: str, field: str = "id") -> DataFrame:
    """children with parent_id, the field of the node that the truncated label names in the same row.

    The labels of a row are unique, so that each child meets one parent; children whose parent isn't in parents are left
    out, and a null row key meets nothing. A parent with very many children is a hot key of the left side alone, which
    adaptive execution splits.
    """
    named = parents.select(row_key, F.col("label").alias("parent_label"), F.col(field).alias("parent_id"))
    return children.join(named, [row_key, "parent_label"])


def _documents(df: DataFrame, key: str, value: Column, name: str, label: str) -> DataFrame:
    """(doc, value), written once, so that a long text is parsed once for all tables. doc holds a number of the row beside
    its key, as keys may be null or repeat; numbers drawn at run time must be written before use."""
    return materialize(df.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(key).alias("key")).alias("doc"), value.alias(name)), label)


#: What is read of a rollout snapshot. content stays raw text at first, as its form depends on the item's type.
ROLLOUT = "array<struct<id:string,turns:array<struct<id:string,status:string,items:array<struct<id:string,type:string,aggregatedOutput:string,content:string>>>>>>"
PARTS = "array<struct<type:string,text:string,path:string>>"


def rollout_tables(snapshots: DataFrame) -> dict[str, DataFrame]:
    """turn, item, part and output tables of rollout snapshots: snapshot_id, label, parent_label, parent_id, id, type.

    The nodes are shredded by schema path; each parent is the node of the truncated label."""
    parsed = _documents(snapshots, "snapshot_id", F.from_json(valid_json(F.col("threads")), ROLLOUT), "threads", "dewey-rollout")
    nodes = shred(parsed, "doc", "threads")
    threads, turns, items = nodes["$"], nodes["$.turns"], nodes["$.turns.items"]
    asked = items.filter(F.col("type") == "userMessage").select("doc", "label", F.posexplode(F.from_json("content", PARTS)).alias("pos", "part"))
    below = lambda label, pos: [label.alias("label"), parent_label(label).alias("parent_label"), pos.alias("id")]
    parts = asked.select("doc", *below(F.concat_ws(".", "label", "pos"), F.col("pos").cast("string")), F.col("part.type").alias("type"))
    outputs = items.filter(F.col("aggregatedOutput").isNotNull()).select("doc", *below(F.concat(F.col("label"), F.lit(".0")), F.lit("0")), F.lit("aggregatedOutput").alias("type"))
    linked = {"turn": (turns.withColumn("type", F.col("status")), threads), "item": (items, turns), "part": (parts, items), "output": (outputs, items)}
    return {level: _named(link(children, parents, "doc"), "snapshot_id") for level, (children, parents) in linked.items()}


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("doc.key").alias(key), "label", "parent_label", "parent_id", "id", F.coalesce(F.col("type"), F.lit("")).alias("type"))


def backup_tables(backups: DataFrame) -> dict[str, DataFrame]:
    """conversation, message and part tables of tree backups, as rollout_tables gives them. A conversation's parent is its
    backup. Messages name their conversation by id, not by nesting; those of no conversation in the same backup have no
    parent here and are left out."""
    fields = lambda name, *kept: F.transform(F.col(f"data.{name}"), lambda x: F.when(x.isNotNull(), F.struct(*kept_of(x, kept))))
    kept_of = lambda x, kept: [x[k] if k != "contentParts" else F.transform(x[k], lambda p: F.when(p.isNotNull(), F.struct(p["type"].alias("type")))).alias(k) for k in kept]
    narrow = F.struct(fields("conversations", "id", "messageCount").alias("conversations"), fields("messages", "id", "conversationId", "role", "contentParts").alias("messages"))
    nodes = shred(_documents(backups, "backup_id", narrow, "data", "dewey-backup"), "doc", "data")
    conversations, messages, parts = nodes["conversations"], nodes["messages"], nodes["messages.contentParts"]
    listed = conversations.select("doc", F.col("id").alias("conversationId")).distinct()
    owned = messages.join(listed, ["doc", "conversationId"], "left_semi")
    placed = parts.withColumn("id", F.element_at(F.split("label", r"\."), -1))
    return {
        "conversation": _named(conversations.withColumns({"parent_id": F.col("doc.key").cast("string"), "type": F.col("messageCount").cast("string")}), "backup_id"),
        "message": _named(owned.withColumns({"parent_id": F.col("conversationId"), "type": F.col("role")}), "backup_id"),
        "part": _named(link(placed, messages, "doc"), "backup_id"),
    }


def found(snapshots: DataFrame, backups: DataFrame) -> DataFrame:
    """Distinct (src, row_id, parent_id, child_level, child_id, child_type) over both nested tables."""
    out = None
    for src, key, tables in (("codex_rollout_v1", "snapshot_id", rollout_tables(snapshots)), ("room_ferry_backup_v1", "backup_id", backup_tables(backups))):
        for level, rows in tables.items():
            rows = rows.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("row_id"), "parent_id", F.lit(level).alias("child_level"), F.col("id").alias("child_id"), F.col("type").alias("child_type"))
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()
