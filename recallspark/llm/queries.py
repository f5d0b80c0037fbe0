"""Queries of the problems of training text over the driver's tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import conversations, copies, history, leakage, packing, pii, splitting
from recallspark.session import materialize, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found(table(spark, d, "records_v1"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(table(spark, d, "records_v1"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "records_v1"), table(spark, d, "interaction_log"), table(spark, d, "name_lexicon"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with typed placeholders."""
    texts = pii.sources(table(spark, d, "records_v1"), table(spark, d, "interaction_log"))
    return pii.redact(texts, pii.detect(texts, table(spark, d, "name_lexicon")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The paths to drop, the only set that the query's line in TESTDATA.md describes. Its SQL still states those kept."""
    return conversations.dropped(table(spark, d, "records_v1_branch_memberships"), table(spark, d, "records_v1"))


def p7_dropped(spark: SparkSession, d: str) -> DataFrame:
    """The same paths, with SQL that states them."""
    return p7_found(spark, d)


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The whole conversations; the SQL under the name p7_found states these."""
    return conversations.found(table(spark, d, "records_v1_branch_memberships"), table(spark, d, "records_v1"))


def _log_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the log's two sides, a message of the user and the agent's reply to it; a null reply was never said.
    All messages before one in its channel are candidates."""
    log, parts = table(spark, d, "interaction_log"), ("user_msg", "ai_reply")
    said = [(F.lit("user"), F.lit(True)), (F.col("agent_id"), F.col("ai_reply").isNotNull())]
    user, reply = (log.filter(kept).select((2 * F.col("id") + k).alias("key"), "agent_id", "logged_at", who.alias("who"), F.col(parts[k]).alias("text")) for k, (who, kept) in enumerate(said))
    return conversations.disentangle(user.unionByName(reply), "key", "agent_id", "logged_at", "who", "text")


def _said(**columns: str) -> list:
    """The row and the side of the log that a key names."""
    return [x for c, prefix in columns.items() for x in (F.shiftright(c, 1).alias(f"{prefix}id"), F.when(F.pmod(c, F.lit(2)) == 0, "user_msg").when(F.col(c).isNotNull(), "ai_reply").alias(f"{prefix}part"))]


def p7_reply_links(spark: SparkSession, d: str) -> DataFrame:
    return _log_links(spark, d).select(*_said(key="", parent="parent_"), "score")


def p7_link_trees(spark: SparkSession, d: str) -> DataFrame:
    """The thread of each message of the log: the tree of reply links it is in, and its depth there."""
    links = materialize(_log_links(spark, d), "links")
    return conversations.threads(links).select(*_said(key="", root="root_"), "depth")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.measure(table(spark, d, "documents")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The sources' shares in the containers of p8_containers."""
    return packing.mixture_report(materialize(p8_containers(spark, d), "packed"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p4_found, p5_found, p5_redacted, p7_found, p7_dropped, p7_kept, p7_reply_links, p7_link_trees, p8_containers, p8_mixture, p9_found, p10_found, p10_pieces)}


_WORDS = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_BLANK = r"'[\s\x{3000}\x{a0}\x{85}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]*'"
_SQL = {
    "p2_found": rf"""WITH r AS (SELECT id, content, {_WORDS.format("content")} AS w FROM records_v1 WHERE id IS NOT NULL AND content IS NOT NULL AND NOT regexp_full_match(content, {_BLANK})),
o AS (SELECT id, content FROM r WHERE regexp_matches(content, '^\s*\{{') AND json_valid(content)),
j AS (SELECT o.id, replace(replace(regexp_replace(lower(t.fullkey), '[^\p{{L}}\p{{N}}.\[\]]+', ' ', 'g'), ' .', '.'), '. ', '.') || '=' || CASE t.type WHEN 'OBJECT' THEN chr(3) || 'o' WHEN 'ARRAY' THEN chr(3) || 'a' WHEN 'NULL' THEN 'null' ELSE {_WORDS.format("json_extract_string(t.value, '$')")} END AS pair FROM o, json_tree(o.content) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::varchar IN ('{{}}', '[]')),
p AS (SELECT id, list_filter(string_split_regex(content, '[;\r\n]+'), lambda x: NOT regexp_full_match(x, {_BLANK})) AS parts FROM r WHERE NOT regexp_matches(content, '^\s*\{{') AND regexp_matches(content, '[:=]') AND regexp_matches(content, '[;\r\n]')),
l AS (SELECT id, list_sort(list_transform(parts, lambda x: {_WORDS.format("regexp_extract(x, '^([^:=]+)[:=]', 1)")} || chr(1) || {_WORDS.format("regexp_replace(x, '^[^:=]+[:=]', '')")})) AS pairs FROM p WHERE len(parts) >= 3 AND len(list_filter(parts, lambda x: regexp_matches(regexp_extract(x, '^([^:=]*)[:=]', 1), '[\p{{L}}\p{{N}}]'))) = len(parts)),
k AS (SELECT id, 'w' AS kind, w AS key FROM r UNION ALL SELECT id, 'j', string_agg(pair, chr(2) ORDER BY pair) FROM j GROUP BY id UNION ALL SELECT id, 'l', array_to_string(pairs, chr(2)) FROM l),
f AS (SELECT id, min(id) OVER (PARTITION BY kind, key) AS first FROM k)
SELECT min(first)::bigint AS first_id, id::bigint AS dup_id FROM f GROUP BY id HAVING min(first) < id""",
    "p7_found": r"""WITH m AS (SELECT DISTINCT record_rowid, branch_id, position FROM records_v1_branch_memberships),
r AS (SELECT id, conversation_id, lower(trim(role)) AS role, coalesce(regexp_full_match(content, '[\s\x{3000}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]*'), true) AS blank FROM records_v1),
j AS (SELECT conversation_id, branch_id, position, record_rowid, CASE WHEN role IN ('user','assistant') AND NOT blank THEN role END AS turn FROM m JOIN r ON r.id = m.record_rowid),
p AS (SELECT conversation_id, branch_id, count(*) AS n, count(position) AS placed, count(DISTINCT position) AS different, min(position) AS low, max(position) AS high, count(*) FILTER (WHERE turn = 'user') AS users FROM j GROUP BY 1, 2),
s AS (SELECT conversation_id, branch_id, turn, lead(turn) OVER (PARTITION BY conversation_id, branch_id ORDER BY position, record_rowid) AS next FROM j WHERE turn IS NOT NULL),
bad AS (SELECT DISTINCT conversation_id, branch_id FROM s WHERE turn = 'user' AND next IS DISTINCT FROM 'assistant')
SELECT p.conversation_id, p.branch_id FROM p LEFT JOIN bad ON bad.conversation_id = p.conversation_id AND bad.branch_id = p.branch_id WHERE bad.branch_id IS NULL AND users > 0 AND (placed = 0 OR (placed = n AND different = n AND low = 0 AND high = n - 1))""",
    "p9_found": r"""WITH i AS (SELECT item_id, CASE WHEN lang = 'zh' THEN 24 ELSE 60 END AS n, lower(regexp_replace(item_text, '[^\p{L}\p{N}]', '', 'g')) AS t FROM eval_items),
g AS (SELECT DISTINCT item_id, n, substring(t, unnest(range(1, length(t) - n + 2)), n) AS gram FROM i),
d AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS t FROM documents),
w AS (SELECT doc_id, 60 AS n, substring(t, unnest(range(1, length(t) - 60 + 2)), 60) AS gram FROM d UNION ALL SELECT doc_id, 24, substring(t, unnest(range(1, length(t) - 24 + 2)), 24) FROM d)
SELECT DISTINCT doc_id, item_id FROM w JOIN g ON g.n = w.n AND g.gram = w.gram""",
}


def oracle_sql() -> dict[str, str]:
    # The paths that are dropped are the others: the same conditions, denied.
    kept, condition = _SQL["p7_found"].split(" WHERE bad.branch_id IS NULL AND ")
    return _SQL | {"p7_dropped": f"{kept} WHERE NOT (bad.branch_id IS NULL AND {condition})"}
