"""Queries of the general problems p1, p3 and p6 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.operators import dewey, hierarchy, timestamps
from recallspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dewey.found(table(spark, d, "codex_rollout_v1"), table(spark, d, "room_ferry_backup_v1"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found(table(spark, d, "branch_path"), table(spark, d, "room_ferry_backup_v1"))


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants of each branch from its Euler interval."""
    placed = hierarchy.forest(table(spark, d, "branch_path"), "conversation_id", "branch_id", "parent_branch_id")
    return placed.select(F.col("tree").alias("conversation_id"), F.col("node").alias("branch_id"), "depth", F.coalesce("descendants", F.lit(-1).cast("bigint")).alias("descendants"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "records_v1"), table(spark, d, "guijian_message"), table(spark, d, "source_profiles"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p3_found, p3_intervals, p6_found)}


_TREE = """n AS (SELECT DISTINCT 'branch_path' AS src, NULL::bigint AS row_, conversation_id AS tree, branch_id AS node, parent_branch_id AS parent FROM branch_path
 UNION SELECT DISTINCT 'room_ferry_backup_v1', backup_id, m.conversationId, m.sourceMessageId, m.parentSourceMessageId FROM (SELECT backup_id, unnest(data.messages) AS m FROM room_ferry_backup_v1)),
r AS (SELECT n.src, n.row_, n.tree, n.node, n.node AS root, 0 AS depth FROM n LEFT JOIN n p ON p.src = n.src AND p.row_ IS NOT DISTINCT FROM n.row_ AND p.tree = n.tree AND p.node = n.parent WHERE p.node IS NULL
 UNION ALL SELECT n.src, n.row_, n.tree, n.node, r.root, r.depth + 1 FROM n JOIN r ON r.src = n.src AND r.row_ IS NOT DISTINCT FROM n.row_ AND r.tree = n.tree AND r.node = n.parent)"""

_SQL = {
    "p1_found": """WITH h AS (SELECT snapshot_id, unnest(json_extract(threads, '$[*]')) AS h FROM codex_rollout_v1 WHERE json_valid(threads)),
t AS (SELECT snapshot_id, json_extract_string(h, '$.id') AS hid, unnest(json_extract(h, '$.turns[*]')) AS t FROM h),
i AS (SELECT snapshot_id, json_extract_string(t, '$.id') AS tid, unnest(json_extract(t, '$.items[*]')) AS i FROM t),
p AS (SELECT snapshot_id, json_extract_string(i, '$.id') AS iid, unnest(json_extract(i, '$.content[*]')) AS p, unnest(range(len(json_extract(i, '$.content[*]')))) AS k FROM i WHERE json_extract_string(i, '$.type') = 'userMessage'),
c AS (SELECT backup_id, unnest(data.conversations) AS c FROM room_ferry_backup_v1), m AS (SELECT backup_id, unnest(data.messages) AS m FROM room_ferry_backup_v1),
q AS (SELECT backup_id, m.id AS mid, unnest(m.contentParts) AS q, unnest(range(len(m.contentParts))) AS k FROM m)
SELECT DISTINCT 'codex_rollout_v1' AS src, snapshot_id AS row_id, hid AS parent_id, 'turn' AS child_level, json_extract_string(t, '$.id') AS child_id, coalesce(json_extract_string(t, '$.status'), '') AS child_type FROM t
UNION SELECT 'codex_rollout_v1', snapshot_id, tid, 'item', json_extract_string(i, '$.id'), coalesce(json_extract_string(i, '$.type'), '') FROM i
UNION SELECT 'codex_rollout_v1', snapshot_id, iid, 'part', k::varchar, coalesce(json_extract_string(p, '$.type'), '') FROM p
UNION SELECT 'codex_rollout_v1', snapshot_id, json_extract_string(i, '$.id'), 'output', '0', 'aggregatedOutput' FROM i WHERE json_extract_string(i, '$.aggregatedOutput') IS NOT NULL
UNION SELECT 'room_ferry_backup_v1', backup_id, backup_id::varchar, 'conversation', c.id, coalesce(c.messageCount::varchar, '') FROM c
UNION SELECT 'room_ferry_backup_v1', m.backup_id, m.m.conversationId, 'message', m.m.id, coalesce(m.m.role, '') FROM m JOIN c ON c.backup_id = m.backup_id AND c.c.id = m.m.conversationId
UNION SELECT 'room_ferry_backup_v1', backup_id, mid, 'part', k::varchar, coalesce(q.type, '') FROM q""",
    "p3_found": f"""WITH RECURSIVE {_TREE}, l AS (SELECT DISTINCT backup_id, c.id AS cid, c.currentLeafSourceMessageId AS leaf FROM (SELECT backup_id, unnest(data.conversations) AS c FROM room_ferry_backup_v1)),
a AS (SELECT n.src, n.row_, n.tree, n.node FROM n WHERE src = 'branch_path' UNION SELECT n.src, n.row_, n.tree, n.node FROM n JOIN l ON n.row_ = l.backup_id AND n.tree = l.cid AND n.node = l.leaf)
SELECT DISTINCT a.src, a.tree AS tree_id, a.node AS node_id, coalesce(r.root, '') AS root_id, coalesce(r.depth, -1)::int AS depth FROM a LEFT JOIN r ON r.src = a.src AND r.row_ IS NOT DISTINCT FROM a.row_ AND r.tree = a.tree AND r.node = a.node""",
    "p3_intervals": f"""WITH RECURSIVE {_TREE}, u AS (SELECT tree, node, node AS anc FROM n WHERE src = 'branch_path' UNION ALL SELECT u.tree, u.node, n.parent FROM u JOIN n ON n.src = 'branch_path' AND n.tree = u.tree AND n.node = u.anc JOIN r ON r.src = 'branch_path' AND r.tree = u.tree AND r.node = u.anc WHERE n.parent IS NOT NULL AND r.depth > 0),
d AS (SELECT tree, anc, count(*) - 1 AS n FROM u GROUP BY 1, 2)
SELECT n.tree AS conversation_id, n.node AS branch_id, coalesce(r.depth, -1)::int AS depth, CASE WHEN r.depth IS NULL THEN -1 ELSE d.n END AS descendants FROM n LEFT JOIN r ON r.src = n.src AND r.tree = n.tree AND r.node = n.node LEFT JOIN d ON d.tree = n.tree AND d.anc = n.node WHERE n.src = 'branch_path'""",
}


def instants_sql(every: bool = False) -> str:
    """p6_found in SQL; every: values in the normal form too. It shares the list of written forms with the operator; the civil time, offsets, zones and their policies are
    worked out by the other engine."""
    forms = []
    for form in timestamps.FORMS:
        fits = f"regexp_matches(raw, '{form.pattern}')" + (f" AND ord = '{form.order}'" if form.order else "")
        forms.append(f"WHEN {fits} THEN regexp_replace(raw, '{form.pattern}', '{form.template.replace('$', chr(92))}')")
    return rf"""WITH s AS (SELECT source_kind, min(zone_name) AS zone, min(upper(date_order)) AS ord FROM source_profiles GROUP BY 1),
v AS (SELECT 'records_v1' AS src, id AS row_id, 'created_at' AS field, created_at AS t, zone, ord FROM records_v1 LEFT JOIN s USING (source_kind) UNION ALL SELECT 'records_v1', id, 'source_cutoff_at', source_cutoff_at, zone, ord FROM records_v1 LEFT JOIN s USING (source_kind)
 UNION ALL SELECT 'guijian_message', message_key, 'created_at', created_at, room_zone, NULL FROM guijian_message),
r AS (SELECT src, row_id, field, zone, ord AS given, regexp_replace(translate(t, '０１２３４５６７８９：／－．', '0123456789:/-.'), '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g') AS raw FROM v WHERE t IS NOT NULL{"" if every else f" AND NOT regexp_matches(t, '{timestamps.NORMAL_FORM}')"}),
o AS (SELECT *, CASE WHEN given IN ('DMY', 'MDY') THEN given WHEN TRY_CAST(regexp_extract(raw, '^(\d{{1,2}})/\d{{1,2}}/\d{{4}}', 1) AS int) > 12 THEN 'DMY' WHEN TRY_CAST(regexp_extract(raw, '^\d{{1,2}}/(\d{{1,2}})/\d{{4}}', 1) AS int) > 12 THEN 'MDY' END AS ord FROM r),
f AS (SELECT *, string_split(CASE {" ".join(forms)} END, '|') AS p FROM o),
g AS (SELECT *, TRY_CAST(p[1] AS int) AS y, CASE WHEN regexp_full_match(p[2], '\d+') THEN TRY_CAST(p[2] AS int) WHEN strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substring(p[2], 1, 3))) % 3 = 1 THEN (strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substring(p[2], 1, 3))) + 2) // 3 END AS mo, TRY_CAST(p[3] AS int) AS d,
 TRY_CAST(coalesce(nullif(p[4], ''), '0') AS int) AS h0, lower(nullif(p[8], '')) AS mer, TRY_CAST(coalesce(nullif(p[5], ''), '0') AS int) AS mi, TRY_CAST(coalesce(nullif(p[6], ''), '0') AS int) AS sec, TRY_CAST(rpad(substring(p[7], 1, 6), 6, '0') AS int) AS frac, nullif(p[9], '') AS off, nullif(p[10], '') AS zn FROM f),
h AS (SELECT *, CASE WHEN mer IS NULL THEN h0 WHEN h0 > 12 AND mer IN ('a', 'p') THEN NULL WHEN h0 > 12 THEN h0 WHEN mer IN ('p', '下午') THEN h0 % 12 + 12 ELSE h0 % 12 END AS hh, regexp_extract(off, '(?i)^(?:UTC|GMT)?([+-])(\d{{1,2}}):?(\d{{2}})?$', ['sign', 'hours', 'minutes']) AS o3, coalesce(zn, zone) AS lz FROM g),
c AS (SELECT *, TRY_CAST(nullif(o3.hours, '') AS int) * 60 + coalesce(TRY_CAST(nullif(o3.minutes, '') AS int), 0) AS away, CASE WHEN hh < 24 AND sec < 60 AND mi < 60 THEN TRY(make_timestamp(y::bigint, mo::bigint, d::bigint, hh::bigint, mi::bigint, sec::double)) END AS wall FROM h),
i AS (SELECT *, CASE WHEN off IS NULL AND regexp_full_match(lz, 'UTC|GMT|Z|[A-Za-z]+(/[A-Za-z0-9_+\-]+)+') THEN TRY(wall AT TIME ZONE lz) END AS inst, TRY_CAST(CASE WHEN regexp_full_match(raw, '\d{{1,17}}(\.\d+)?') THEN regexp_replace(raw, '^(\d+(?:\.\d{{1,9}})?)\d*$', '\1') END AS DECIMAL(28,9)) AS n FROM c),
e AS (SELECT src, row_id, field, CASE WHEN regexp_full_match(raw, '\d+(\.\d+)?') THEN CASE WHEN n >= 946684800 AND n < 4133980800 THEN floor(n * 1000000)::bigint WHEN n >= 946684800000 AND n < 4133980800000 THEN floor(n * 1000)::bigint WHEN n >= 946684800000000 AND n < 4133980800000000 THEN floor(n)::bigint END
 WHEN upper(off) IN ('Z', 'UTC', 'GMT') THEN epoch_us(wall) + frac WHEN off IS NOT NULL THEN CASE WHEN away <= 1080 THEN epoch_us(wall) + frac - CASE o3.sign WHEN '-' THEN -1 ELSE 1 END * away::bigint * 60000000 END
 WHEN ((inst - INTERVAL 2 HOUR) AT TIME ZONE lz) = wall THEN epoch_us(inst - INTERVAL 2 HOUR) + frac WHEN ((inst - INTERVAL 1 HOUR) AT TIME ZONE lz) = wall THEN epoch_us(inst - INTERVAL 1 HOUR) + frac WHEN ((inst - INTERVAL 30 MINUTE) AT TIME ZONE lz) = wall THEN epoch_us(inst - INTERVAL 30 MINUTE) + frac ELSE epoch_us(inst) + frac END AS utc_micros FROM i)
SELECT src, row_id, field, utc_micros::bigint AS utc_micros FROM e WHERE utc_micros IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return _SQL | {"p6_found": instants_sql()}
