"""Further queries of the engine's operators: identity, projection, collections, packets, traces and the full cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.functions import text as tx
from recallspark.operators import claims, collections, context, events, identity, lexical, packets, regression, scoring
from recallspark.plans import intents
from recallspark.queries.problems import instants_sql
from recallspark.queries.reference import _EVENTS, _LC, _SQL, _events, _records, query
from recallspark.session import scratch_path, table
from recallspark.sources import captures, exports, ledger, packages
from recallspark.streaming import views


def queries() -> dict:
    """Registered with those of the reference module."""
    return {}


def _any(column: str, markers) -> str:
    """SQL for packets.has_any."""
    quoted = [m.replace("'", "''") for m in markers]
    return "coalesce(" + " OR ".join(f"contains(lower({column}), '{m}')" for m in quoted) + ", false)"


# Identity -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT record, owner, shared, epoch FROM st")
def r_e02_fold_state(spark: SparkSession, d: str) -> DataFrame:
    return identity.fold_state(_events(spark, d))


@query(f"WITH {_EVENTS} SELECT record, string_agg(agent, ',' ORDER BY agent) AS agents FROM lg GROUP BY 1")
def r_g15_grant_sets(spark: SparkSession, d: str) -> DataFrame:
    return identity.effective_grants(_events(spark, d))


@query(f"""WITH {_EVENTS}, a AS (SELECT 'agt-' || i AS agent, CASE WHEN i % 3 = 0 THEN 'disabled' ELSE 'active' END AS state FROM range(8) t(i))
SELECT a.agent, state, (SELECT count(*) FROM st WHERE owner = a.agent) AS owned, (SELECT count(*) FROM lg WHERE lg.agent = a.agent) AS granted FROM a""")
def r_e17_agent_report(spark: SparkSession, d: str) -> DataFrame:
    agents = spark.createDataFrame([(f"agt-{i}", "disabled" if i % 3 == 0 else "active") for i in range(8)], "agent string, state string")
    return identity.agent_report(agents, _events(spark, d))


@query("""WITH l AS (SELECT user_id, arg_max(struct_pack(w := CASE WHEN event_id % 5 > 0 THEN value / 200 END, x := CASE WHEN event_id % 7 > 0 THEN value / 300 - 0.3 END), event_id) AS l FROM events GROUP BY 1)
SELECT user_id, greatest(0.0, least(1.0, coalesce(l.w, 0.5)))::double AS warmth, greatest(0.0, least(1.0, coalesce(l.x, 0.4)))::double AS directness FROM l""")
def r_e20_clamped_updates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 > 0, F.col("value") / 200).alias("warmth"), F.when(F.col("event_id") % 7 > 0, F.col("value") / 300 - 0.3).alias("directness"))
    return identity.clamp_updates(e, "user_id", "event_id", {"warmth": 0.5, "directness": 0.4})


# Projection -----------------------------------------------------------------------------------------------------------------

_OLD = "SELECT user_id AS claim, arg_min(event_type, event_id) AS said, 3 AS version FROM events WHERE user_id % 3 = 0 GROUP BY 1"


@query(f"""WITH old AS ({_OLD}), s AS (SELECT e.user_id AS claim, e.event_id AS seq, e.event_type AS said, lag(e.event_type) OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS b, old.said AS o, coalesce(old.version, 0) AS v FROM events e LEFT JOIN old ON old.claim = e.user_id)
SELECT claim, said, seq, (v + row_number() OVER (PARTITION BY claim ORDER BY seq))::bigint AS version FROM s WHERE said IS DISTINCT FROM coalesce(b, o)""")
def r_k01_g04_next_versions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("user_id").alias("claim"), F.col("event_id").alias("seq"), F.col("event_type").alias("said"))
    old = s.filter(F.col("claim") % 3 == 0).groupBy("claim").agg(F.min_by("said", "seq").alias("said"), F.lit(3).alias("version"))
    return claims.next_versions(old, s, "claim", "seq", "said")


_VERSIONED = "v AS (SELECT o_custkey AS claim_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 THEN 'active' ELSE 'superseded' END AS status FROM orders)"
_READ = f"{_VERSIONED}, g AS (SELECT o_custkey AS claim_id, count(*) AS n_evidence FROM orders GROUP BY 1 HAVING bool_and(o_orderpriority <> '1-URGENT'))"


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("record_id"))
    numbered = o.withColumn("version", F.row_number().over(Window.partitionBy("claim_id").orderBy("record_id")))
    return claims.with_status(numbered, "claim_id")


def _open_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderpriority") != "1-URGENT")


@query(f"WITH {_READ} SELECT v.claim_id, version::bigint AS version, n_evidence FROM v JOIN g USING (claim_id) WHERE status = 'active'")
def r_k03_read_claims(spark: SparkSession, d: str) -> DataFrame:
    v = _versioned(spark, d)
    return claims.read_claims(v, v.select("claim_id", "record_id"), _open_orders(spark, d), "o_orderkey").withColumn("version", F.col("version").cast("bigint"))


@query(f"WITH {_READ} SELECT v.claim_id, version::bigint AS version, o.o_orderkey AS record_id FROM v JOIN g USING (claim_id) JOIN orders o ON o.o_custkey = v.claim_id WHERE status = 'active'")
def r_k03_provenance(spark: SparkSession, d: str) -> DataFrame:
    v = _versioned(spark, d)
    return claims.provenance(v, v.select("claim_id", "record_id"), _open_orders(spark, d), "o_orderkey").withColumn("version", F.col("version").cast("bigint"))


_SHOWN = "m AS (SELECT DISTINCT l_orderkey AS conflict_id, l_partkey AS claim_id FROM lineitem), s AS (SELECT conflict_id FROM m GROUP BY 1 HAVING bool_and(claim_id % 10 <> 3)), c AS (SELECT m.claim_id, m.conflict_id, o_orderstatus AS status FROM m JOIN s USING (conflict_id) JOIN orders ON o_orderkey = m.conflict_id)"


def _claim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conflict_id"), F.col("l_partkey").alias("claim_id"))
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("conflict_id"), F.col("o_orderstatus").alias("status"))
    readable = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") % 10 != 3).alias("readable"))
    return claims.claim_conflicts(m, status, readable)


@query(f"WITH {_SHOWN} SELECT claim_id, conflict_id, status FROM c")
def r_j06_claim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _claim_conflicts(spark, d)


@query(f"WITH {_SHOWN}, e AS (SELECT DISTINCT l_suppkey AS record_id, l_partkey AS claim_id FROM lineitem) SELECT record_id, conflict_id, status, count(DISTINCT e.claim_id) AS n_claims FROM supplier JOIN e ON record_id = s_suppkey JOIN c USING (claim_id) GROUP BY 1, 2, 3")
def r_m15_conflict_annotations(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("record_id"), F.col("l_partkey").alias("claim_id"))
    records = table(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"))
    return claims.annotate_conflicts(records, "record_id", evidence, _claim_conflicts(spark, d))


@query(f"WITH {_VERSIONED}, t AS (SELECT claim_id, max(version) AS version FROM v GROUP BY 1) SELECT event_id, user_id * 5 AS target, t.version::bigint AS target_version, CASE WHEN t.claim_id IS NOT NULL THEN 'active' END AS target_status FROM events LEFT JOIN t ON t.claim_id = user_id * 5")
def r_j07_decision_targets(spark: SparkSession, d: str) -> DataFrame:
    decisions = table(spark, d, "events").select("event_id", (F.col("user_id") * 5).alias("target"))
    return claims.decision_targets(decisions, _versioned(spark, d)).withColumn("target_version", F.col("target_version").cast("bigint"))


@query("SELECT count(*) AS n_hashes, coalesce(sum(n - 1), 0)::bigint AS n_rows FROM (SELECT count(*) AS n FROM records_v1 WHERE content_sha256 IS NOT NULL GROUP BY content_sha256 HAVING count(*) > 1)")
def r_g13_duplicate_counters(spark: SparkSession, d: str) -> DataFrame:
    return claims.duplicate_counters(_records(spark, d), "content_sha256")


@query("""WITH v AS (SELECT user_id AS claim, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - (event_id % 11 = 0)::int)::bigint AS version, CASE WHEN event_id % 17 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'superseded' ELSE 'active' END ELSE 'superseded' END AS status FROM events),
n AS (SELECT claim, version, count(*) AS n, min(status) AS stated FROM v GROUP BY 1, 2), x AS (SELECT *, max(version) OVER (PARTITION BY claim) AS last FROM n)
SELECT claim, version, fault FROM (SELECT claim, version, CASE WHEN n > 1 THEN 'repeated' WHEN stated = 'active' AND version < last THEN 'not_superseded' WHEN stated <> 'active' AND version = last THEN 'not_active' END AS fault FROM x) WHERE fault IS NOT NULL""")
def r_e12_status_integrity(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    up, down = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy(i.desc())
    stated = F.when((i % 17 == 0) | (F.row_number().over(down) == 1), F.when(i % 5 == 0, "superseded").otherwise("active")).otherwise("superseded")
    v = table(spark, d, "events").select(F.col("user_id").alias("claim"), (F.row_number().over(up) - (i % 11 == 0).cast("int")).cast("bigint").alias("version"), stated.alias("status"))
    return claims.integrity(v, "claim")


# Collections ------------------------------------------------------------------------------------------------------------------

_TESTS = {
    "question_or_prompt": _any("content", packets.QUESTION), "retelling_or_recollection": _any("content", packets.RETELLING), "plan_or_candidate": _any("content", packets.PLAN),
    "explicit_occurrence_or_completion": f"{_any('content', packets.COMPLETION)} AND NOT {_any('content', packets.NOT_COMPLETED)}", "choice_or_advice_evidence": _any("content", packets.ATTRIBUTION),
}
_LABELLED = "l AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _TESTS.items()) + "], lambda x: x IS NOT NULL) AS labels FROM records_v1)"
_PARTS = "p AS (SELECT *, list_contains(labels, 'explicit_occurrence_or_completion') AND NOT list_contains(labels, 'question_or_prompt') AND NOT list_contains(labels, 'retelling_or_recollection') AND NOT list_contains(labels, 'plan_or_candidate') AS occurrence, list_contains(labels, 'retelling_or_recollection') AS retelling, list_contains(labels, 'plan_or_candidate') AS plan, list_contains(labels, 'choice_or_advice_evidence') AS attribution FROM l)"


@query(f"WITH {_LABELLED} SELECT id, CASE WHEN len(labels) = 0 THEN 'topic_mention' ELSE array_to_string(labels, ',') END AS labels FROM l")
def r_m10_occurrence_labels(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", F.array_join(packets.occurrence_labels(F.col("content")), ",").alias("labels"))


@query(f"WITH {_LABELLED}, {_PARTS} " + " UNION ALL ".join(f"SELECT '{n}' AS partition, count(*) AS n, min(id) AS first_key FROM p WHERE {n} HAVING count(*) > 0" for n in ("occurrence", "retelling", "plan", "attribution")))
def r_g09_label_partitions(spark: SparkSession, d: str) -> DataFrame:
    return packets.label_partitions(_records(spark, d), "id", "content")


@query(f"""WITH {_LABELLED}, {_PARTS}, e AS (SELECT * FROM p WHERE {_any('content', ['lantern', 'laterne'])} ORDER BY imported_at NULLS LAST, id::varchar LIMIT 24)
SELECT count(*) AS n_evidence, least(count(DISTINCT CASE WHEN occurrence THEN coalesce('day:' || strftime(imported_at + INTERVAL 8 HOUR, '%Y-%m-%d'), 'record:' || id) END), 12) AS event_count_lower_bound,
{", ".join(f"coalesce(string_agg(CASE WHEN {n} THEN id::varchar END, ',' ORDER BY imported_at NULLS LAST, id::varchar), '') AS {n}_ids" for n in ("occurrence", "plan", "attribution", "retelling"))}, CASE WHEN count(*) > 0 THEN 'bounded_evidence_collected' ELSE 'no_evidence' END AS status FROM e""")
def r_m09_event_collection(spark: SparkSession, d: str) -> DataFrame:
    return packets.event_collection(_records(spark, d), "id", "imported_at", "content", ["lantern", "Laterne"])


_NAMED = """m AS (SELECT id, imported_at, lower(trim(unnest(regexp_extract_all(content, '([A-Z]{3,6})-[0-9a-z]{8}', 1)))) AS name, verified, id % 4 = 0 AS cand, lower(trim(role)) = 'user' AS rel FROM records_v1 WHERE source_kind <> 'agent-log'),
i AS (SELECT name, CASE WHEN coalesce(bool_or(verified AND id % 50 = 0), false) AND coalesce(bool_or(rel), false) THEN 'confirmed' WHEN coalesce(bool_or(cand), false) THEN 'candidate' ELSE 'unresolved' END AS status, min(imported_at) AS first_at, count(DISTINCT id) AS n FROM m WHERE length(name) > 0 GROUP BY 1)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    r, i = _records(spark, d), F.col("id")
    m = r.select("id", "imported_at", F.explode(F.regexp_extract_all("content", F.lit("([A-Z]{3,6})-[0-9a-z]{8}"), F.lit(1))).alias("name"), (F.col("verified") & (i % 50 == 0)).alias("ok"), (i % 4 == 0).alias("cand"), (F.lower(F.trim("role")) == "user").alias("rel"), (F.col("source_kind") == "agent-log").alias("out"))
    return packets.named_collection(m, "name", "id", "imported_at", "ok", "cand", "rel", "out")


@query(f"WITH {_NAMED} SELECT name, status, first_at, n FROM i")
def r_m13_named_collection(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d)


@query(f"WITH {_NAMED} SELECT name, status, place FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'unresolved' THEN -n ELSE 0 END, first_at NULLS FIRST, name) AS place FROM i) WHERE place <= 24")
def r_o17_inventory(spark: SparkSession, d: str) -> DataFrame:
    return packets.inventory(_named(spark, d)).select("name", "status", F.col("place").cast("bigint").alias("place"))


@query()
def r_g14_first_mention(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "guijian_message")
    return packets.first_mention(g, "created_at", F.col("room_zone"))


# Unions, filters, packets ------------------------------------------------------------------------------------------------------


@query("SELECT record_id, id, part FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY part, id) AS n FROM (SELECT record_id, id, 0 AS part FROM records_v1 WHERE verified UNION ALL SELECT record_id, id, 1 FROM records_v1)) WHERE n = 1")
def r_u01_first_wins(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("record_id", "id", "verified")
    return packets.ordered_union([r.filter("verified").select("record_id", "id"), r.select("record_id", "id")], "record_id", "id")


_PASSES = "p AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS pass_no, row_number() OVER (ORDER BY imported_at, id) AS rank, id FROM records_v1 WHERE contains({_LC}, '{t}')) WHERE rank <= 40" for i, t in enumerate(("ledger", "bridge", "tower"))) + ")"


@query(f"""WITH {_PASSES}, o AS (SELECT id, min(rank * 10 + pass_no) AS k FROM p GROUP BY 1), t AS (SELECT id, k // 10 AS rank, k % 10 AS pass_no, row_number() OVER (PARTITION BY k % 10 ORDER BY k // 10, id) AS turn FROM o)
SELECT id, pass_no::int AS pass_no, rank::bigint AS rank, place FROM (SELECT *, row_number() OVER (ORDER BY turn, pass_no) AS place FROM t) WHERE place <= 30""")
def r_w09_merged_passes(spark: SparkSession, d: str) -> DataFrame:
    r, out = _records(spark, d), None
    for i, term in enumerate(("ledger", "bridge", "tower")):
        top = lexical.top_k(r.filter(tx.like_contains(F.col("content"), term)).select("id", "imported_at"), [F.col("imported_at").asc(), F.col("id").asc()], 40)
        part = top.select(F.lit(i).alias("pass_no"), "rank", "id")
        out = part if out is None else out.unionByName(part)
    return packets.merge_passes(out, "id", 30).select("id", "pass_no", F.col("rank").cast("bigint").alias("rank"), F.col("place").cast("bigint").alias("place"))


@query('WITH h AS (SELECT record_rowid AS id, position FROM records_v1_branch_memberships WHERE position IS NOT NULL ORDER BY record_rowid, branch_id, position LIMIT 60) SELECT id, bool_or(p) AS "primary" FROM (SELECT id, true AS p FROM h UNION ALL SELECT id + 1, false FROM h WHERE position > 0 UNION ALL SELECT id + 7, false FROM h WHERE position > 0) GROUP BY 1')
def r_j18_expanded_evidence(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "records_v1_branch_memberships").filter(F.col("position").isNotNull()).orderBy("record_rowid", "branch_id", "position").limit(60)
    near = F.when(F.col("position") > 0, F.array(*[F.struct((F.col("record_rowid") + n).alias("id")) for n in (1, 7)]))
    return packets.expand_evidence(h.select(F.col("record_rowid").alias("id"), near.alias("evidence")), "id", "evidence")


@query("SELECT id FROM records_v1 WHERE contains(lower(content), 'lantern')")
def r_p16_subject_only(spark: SparkSession, d: str) -> DataFrame:
    return packets.subject_only(_records(spark, d), "content", "Lantern").select("id")


@query(f"SELECT id FROM records_v1 WHERE {_any('content', packets.RETELLING)} AND {_any('content', ['ledger', 'laterne', 'escalera'])} AND imported_at >= TIMESTAMP '2025-04-10'")
def r_p17_later_retellings(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2025-04-10 00:00:00").cast("timestamp_ntz")
    return packets.retellings(_records(spark, d).withColumn("at", F.col("imported_at").cast("timestamp_ntz")), "content", "at", ["ledger", "Laterne", "escalera"], end).select("id")


_MEANING = ("because", "word", "called", "named", "keeper", "harbour")


@query(f"""WITH s AS (SELECT doc_id, {" + ".join(f"contains(lower(text), '{m}')::int" for m in _MEANING)} AS score, length(text) > 2000 AS long FROM documents)
SELECT doc_id, score, place FROM (SELECT doc_id, score, row_number() OVER (ORDER BY long, score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 6""")
def r_p18_meaning_mentions(spark: SparkSession, d: str) -> DataFrame:
    return packets.meaning_mentions(table(spark, d, "documents"), "doc_id", "text", _MEANING).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT conversation_id, count(*) AS mentions, round(0.6 + CASE WHEN count(*) >= 2 THEN 0.2 ELSE 0 END, 2)::double AS confidence FROM records_v1 WHERE lower(trim(role)) = 'user' AND contains(lower(content), 'ledger') GROUP BY 1")
def r_g16_user_mentions(spark: SparkSession, d: str) -> DataFrame:
    return packets.mention_confidence(_records(spark, d), "conversation_id", "role", "content", "Ledger", 0.6)


@query("SELECT id, logged_at FROM interaction_log ORDER BY logged_at DESC NULLS LAST, id DESC LIMIT 25")
def r_o15_newest(spark: SparkSession, d: str) -> DataFrame:
    return packets.newest(table(spark, d, "interaction_log"), "logged_at", "id", 25).select("id", "logged_at")


@query("SELECT id, record_id, role, verified, substring(content_sha256, 1, 12) AS fingerprint FROM records_v1")
def r_p14_redacted_rows(spark: SparkSession, d: str) -> DataFrame:
    return packets.redacted(_records(spark, d).select("id", "record_id", "role", "verified", "content", "content_sha256"), "content_sha256")


@query("SELECT id, CASE source_kind WHEN 'official-zip' THEN 'chat' WHEN 'tree-backup' THEN 'chat' WHEN 'agent-log' THEN 'agent' ELSE 'other' END AS channel FROM records_v1")
def r_p15_channels(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", packets.channel(F.col("source_kind")).alias("channel"))


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN substring(text, 1, 600) || '…' ELSE text END AS text, length(text)::int AS text_chars, coalesce(length(text) > 600, false) AS text_truncated FROM documents")
def r_m19_bounded(spark: SparkSession, d: str) -> DataFrame:
    return packets.bounded(table(spark, d, "documents").select("doc_id", "text"), ["text"])


@query("""SELECT id, '{"authority":' || coalesce('"' || authority || '"', 'null') || ',"id":' || id || ',"verified":' || coalesce(verified::varchar, 'null') || '}' AS packet FROM records_v1""")
def r_p13_packets(spark: SparkSession, d: str) -> DataFrame:
    r = packets.packet(_records(spark, d), ["id", "authority", "verified"])
    return r.select(F.get_json_object("packet", "$.id").cast("bigint").alias("id"), "packet")


_TOP = f"c AS (SELECT id, row_number() OVER (ORDER BY imported_at, id) AS position, content_sha256 AS group_id FROM records_v1 WHERE contains({_LC}, 'the ')), s AS (SELECT * FROM c WHERE position <= 400)"


@query(f"""WITH {_TOP}, g AS (SELECT group_id, min(position) AS position, arg_min(id, position) AS id FROM s WHERE group_id IS NOT NULL GROUP BY 1)
SELECT c.id, CASE WHEN g.id IS NULL THEN 'result_limit' ELSE 'exact_mirror' END AS reason, coalesce(g.id, -1) AS merged_into, coalesce(g.position, -1) AS merged_position FROM c LEFT JOIN g USING (group_id) WHERE c.position > 400""")
def r_m18_j20_exclusions(spark: SparkSession, d: str) -> DataFrame:
    found = _records(spark, d).filter(tx.like_contains(F.col("content"), "the ")).select("id", "imported_at", F.col("content_sha256").alias("group_id"))
    top = lexical.top_k(found, [F.col("imported_at").asc(), F.col("id").asc()], 400).select("id", F.col("rank").cast("bigint").alias("position"))
    groups = found.filter(F.col("group_id").isNotNull()).select("group_id", "id")
    return packets.exclusions(found, top, groups, "id").fillna(-1, ["merged_into", "merged_position"])


@query("SELECT coalesce(f.k, w.k) AS kind, CASE WHEN f.k IS NULL THEN 'absent' WHEN w.k IS NULL THEN 'unexpected' ELSE 'in_scope' END AS status FROM (SELECT DISTINCT source_kind AS k FROM records_v1) f FULL JOIN (VALUES ('agent-log'), ('official-zip'), ('fax')) w(k) ON f.k = w.k")
def r_s18_kinds_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return packets.kinds_in_scope(_records(spark, d), "source_kind", ["agent-log", "official-zip", "fax"])


@query("SELECT id, role FROM records_v1 WHERE id IN (SELECT record_rowid FROM records_v1_branch_memberships WHERE position = 3)")
def r_s03_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "records_v1_branch_memberships").filter("position = 3")
    return lexical.by_ids(_records(spark, d), "id", ids, "record_rowid").select("id", "role")


# Traces, events and the full cascade ---------------------------------------------------------------------------------------------

_ANCHORS = ("signal tower", "Glass Bridge", "tram depot", "nowhere at all")


def _count_sql(source: str, column: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS anchor, count(*) AS n FROM {source} WHERE contains({column}, '{a.lower()}') HAVING count(*) >= 2" for a in _ANCHORS)


@query(_count_sql("(SELECT lower(text) AS t FROM documents)", "t"))
def r_g03_anchor_counts(spark: SparkSession, d: str) -> DataFrame:
    return lexical.anchor_counts(table(spark, d, "documents"), "text", _ANCHORS)


@query("WITH s AS (SELECT doc_id, captured_at, length(text) AS n, " + " + ".join(f"contains(lower(text), '{a.lower()}')::int" for a in _ANCHORS[:3]) + " AS score FROM documents) SELECT doc_id, score, row_number() OVER (ORDER BY captured_at NULLS FIRST, score DESC, n, doc_id) AS rank FROM s WHERE score >= 2 QUALIFY rank <= 20")
def r_x09_original_trace(spark: SparkSession, d: str) -> DataFrame:
    return lexical.original_trace(table(spark, d, "documents"), "doc_id", "text", "captured_at", _ANCHORS).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH f AS (SELECT id, imported_at, contains({_LC}, 'together') OR contains({_LC}, 'both') AS prioritized FROM records_v1 WHERE contains({_LC}, 'clock') OR contains({_LC}, 'bridge')), n AS (SELECT *, row_number() OVER (PARTITION BY prioritized ORDER BY imported_at NULLS LAST, id) AS k, count(*) OVER (PARTITION BY prioritized) AS size FROM f)
SELECT id, prioritized, rank, truncated FROM (SELECT id, prioritized, row_number() OVER (ORDER BY prioritized DESC, imported_at NULLS LAST, id) AS rank, max(size) OVER () > 200 AS truncated FROM n WHERE k <= 201) WHERE rank <= 200""")
def r_x11_o09_event_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lexical.event_candidates(_records(spark, d), "id", "content", "imported_at", ["clock", "bridge"], ["together", "both"]).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH m AS (SELECT conversation_id, min(imported_at) AS start, count(*) AS n FROM records_v1 WHERE contains({_LC}, 'counted') GROUP BY 1) SELECT conversation_id, start, n FROM m ORDER BY start NULLS LAST, n DESC, conversation_id LIMIT 5")
def r_o10_event_matches(spark: SparkSession, d: str) -> DataFrame:
    m = _records(spark, d).filter(tx.like_contains(F.col("content"), "counted")).groupBy("conversation_id").agg(F.min("imported_at").alias("start"), F.count("*").alias("n"))
    return packets.by_first_known(m, "start", "n", "conversation_id", 20)


def _questions() -> list[tuple]:
    """One question for each tier: made by the planner, and by hand where its own words would stop at an earlier tier."""
    blank = lambda name, **set_: tuple({"question_id": name, "literal": "", "exact": [], "anchored": False, "required": [], "optional": [], "least": 1, "bonus": [], "focused": [], "focused_ascii": [], "focused_other": [], "focused_terms": [], "wide_ascii": [], "wide_other": [], "wide_terms": []} .get(c) if c not in set_ else set_[c] for c in ["question_id", *_COLUMNS[1:]])
    return [
        intents.question_row("planned_anchor", 'Where was "glass bridge" counted'), intents.question_row("planned_plain", "the relay clerk"), intents.question_row("planned_none", '"zzz qqq xxx" and the bridge'),
        blank("exact", exact=["no such words here", "Signal Tower"]), blank("intent", required=["ledger"], optional=["window", "bridge", "tower"], least=2, bonus=["glass"]),
        blank("focused", exact=["zzzz"], focused=["ledger", "keeper"]), blank("relaxed", focused=["ledger", "zzzz"], focused_ascii=["ledger"], focused_other=["tower", "été"]),
        blank("terms", focused_terms=["qqqq", "lanterne"]), blank("wide", wide_ascii=["zzzz"], wide_other=["tower"], wide_terms=["violin", "zzzz"]), blank("wide_relaxed", wide_ascii=["orchard"], wide_other=["tower", "depot"]),
        blank("literal", literal="Telescope"), blank("nothing", literal="zzzz qqqq"),
    ]


_COLUMNS = [part.split()[0] for part in lexical.QUESTION.split(", ")]


def _literal(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_literal(v) for v in value) + "]::varchar[]"
    return str(value).lower() if isinstance(value, (bool, int)) else "'" + str(value).replace("'", "''") + "'"


def _has(column: str, low: str, phrase: bool) -> str:
    return f"list_filter({column}, lambda x: {'length(x) >= 3 AND ' if phrase else ''}contains({low}, lower(x)))"


def _relaxed(a: str, o: str) -> str:
    return f"(len({a}) + len({o}) > 0 AND len({_has(a, 'low', True)}) = len({a}) AND (len({o}) = 0 OR len({_has(o, 'low', True)}) > 0))"


_INTENT = f"(len(required) + len(optional) > 0 AND len({_has('required', 'asc_', False)}) = len(required) AND (len(optional) = 0 OR len({_has('optional', 'asc_', False)}) >= least))"
_TIER_TESTS = [
    f"anchored AND {_INTENT}", f"len({_has('exact', 'low', True)}) > 0", _INTENT, f"len(focused) > 0 AND len({_has('focused', 'low', True)}) = len(focused)", _relaxed("focused_ascii", "focused_other"),
    f"len({_has('focused_terms', 'asc_', False)}) > 0", _relaxed("wide_ascii", "wide_other"), f"len({_has('wide_terms', 'asc_', False)}) > 0", "length(literal) > 0 AND contains(asc_, lower(literal))",
]


@query(f"""WITH q({", ".join(_COLUMNS)}) AS (VALUES {", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in _questions())}), r AS (SELECT id AS key, {_LC} AS asc_, lower(content) AS low FROM records_v1 WHERE content IS NOT NULL),
h AS (SELECT question_id, key, CASE WHEN {_TIER_TESTS[0]} THEN 0 WHEN anchored THEN NULL {" ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(_TIER_TESTS) if i)} END AS tier, len({_has('required', 'asc_', False)}) + len({_has('optional', 'asc_', False)}) + len({_has('bonus', 'asc_', False)}) AS score FROM r, q),
b AS (SELECT question_id, min(tier) AS tier FROM h GROUP BY 1)
SELECT h.question_id, h.key, h.tier::int AS tier, ({_literal(lexical.TIERS)})[h.tier + 1] AS tier_name, h.score::int AS score, row_number() OVER (PARTITION BY h.question_id ORDER BY h.score DESC, h.key) AS rank FROM h JOIN b ON h.question_id = b.question_id AND h.tier = b.tier QUALIFY rank <= 10""")
def r_x10_n18_full_cascade(spark: SparkSession, d: str) -> DataFrame:
    questions = spark.createDataFrame(_questions(), lexical.QUESTION)
    return lexical.full_cascade(_records(spark, d), "id", "content", questions).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def r_x13_event_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Reasons that stand near what the row says of a lantern."""
    r = _records(spark, d).filter(F.col("content").isNotNull())
    return r.select("id", events.exclusion_near(F.col("content"), r"lanterns?|laternen?|lanternes?|linternas?|灯笼").alias("reason"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 2, 3) THEN epoch_us(date_trunc('minute', ts)) ELSE -1 END AS micros FROM events")
def r_m08_clocks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 5
    said = F.when(i == 0, "counted at ").when(i == 1, "it was not counted at ").when(i == 2, "于").when(i == 3, "never. am ").otherwise("see ")
    e = table(spark, d, "events").select("event_id", F.concat(said, F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("Z")).alias("text"))
    return e.select("event_id", F.coalesce(events.clock(F.col("text")), F.lit(-1)).alias("micros"))


# Functions, scores, sources --------------------------------------------------------------------------------------------------------


@query("SELECT id, 'zip://' || message_id || CASE WHEN role IS NULL AND authority IS NULL THEN '' ELSE '?' END AS start, role, authority FROM records_v1")
def r_f_url_references(spark: SparkSession, d: str) -> DataFrame:
    """Parameters written into a reference and read back."""
    ref = tx.reference("zip", F.col("message_id"), role=F.col("role"), authority=F.col("authority"))
    r = _records(spark, d).select("id", "message_id", ref.alias("ref"))
    return r.select("id", F.regexp_extract("ref", r"^[^?]*\??", 0).alias("start"), tx.query_value(F.col("ref"), "role").alias("role"), tx.query_value(F.col("ref"), "authority").alias("authority"))


_TOX = " + ".join(f"CASE WHEN contains(user_msg, '{w}') THEN 0.2 ELSE 0 END" for w in scoring.TOXIC)
_NICE = " + ".join(f"CASE WHEN contains(user_msg, '{w}') THEN 0.1 ELSE 0 END" for w in scoring.SWEET)
_IMP = " + ".join(f"CASE WHEN contains(user_msg, '{w}') THEN {b} ELSE 0 END" for w, b in scoring.IMPORTANCE.items())


@query(f"""SELECT id, round(least(0.5 + {_IMP}, 1.0), 6)::double AS importance, round(least(greatest({_TOX} - ({_NICE}), 0.0), 1.0), 6)::double AS toxicity, CASE WHEN toxicity_score < 0.3 THEN 15 WHEN toxicity_score > 0.7 THEN 120 ELSE 60 END AS interval_minutes,
CASE WHEN id % 7 = 0 THEN 'L3' WHEN id % 3 = 0 THEN 'L2' ELSE 'L1' END AS level, CASE WHEN toxicity_score IS NULL OR toxicity_score = 0 THEN 0.5 ELSE toxicity_score END AS factor FROM interaction_log""")
def r_s213_scalars(spark: SparkSession, d: str) -> DataFrame:
    m, i, t = F.col("user_msg"), F.col("id"), F.col("toxicity_score")
    return table(spark, d, "interaction_log").select("id", scoring.importance(m).alias("importance"), scoring.toxicity(m).alias("toxicity"), scoring.push_interval(t).alias("interval_minutes"), scoring.trigger_level(i % 7 == 0, i % 3 == 0).alias("level"), scoring.falsy_default(t, 0.5).alias("factor"))


_STATES = {"click": ("browsing", 100000), "purchase": ("buying", 400)}


@query("""SELECT user_id, CASE WHEN what = 'click' AND m < 150000 THEN 'browsing' WHEN what = 'purchase' AND m < 600 THEN 'buying' END AS state FROM (SELECT user_id, arg_max(event_type, ts) AS what, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 60000000.0 AS m FROM events GROUP BY 1)""")
def r_s213_user_state(spark: SparkSession, d: str) -> DataFrame:
    return scoring.user_state(table(spark, d, "events"), "user_id", "ts", "event_type", _STATES, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("""SELECT user_id, round(greatest(0.0, least(1.0, a + t)), 6)::double AS warmth, round(greatest(0.0, least(1.0, b - t)), 6)::double AS directness FROM (SELECT user_id, avg(value) / 300 AS a, avg(value) / 1000 AS b, CASE WHEN max(value) / 450 > 0.7 THEN 0.1 ELSE 0.0 END AS t FROM events GROUP BY 1)""")
def r_s213_persona(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 300).alias("a"), (F.avg("value") / 1000).alias("b"), (F.max("value") / 450).alias("s"))
    warmth, directness = scoring.persona_update(F.col("a"), F.col("b"), F.col("s"))
    return p.select("user_id", warmth.alias("warmth"), directness.alias("directness"))


@query("""WITH f AS (SELECT agent_id, id, toxicity_score * 2 - 1 > 0 AS up FROM interaction_log WHERE abs(toxicity_score * 2 - 1) > 0.3 AND agent_id IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY agent_id, up ORDER BY id) AS n FROM f)
SELECT f.agent_id, f.id, p.id AS other, substring(sha256(f.agent_id || '|' || f.id), 1, 8) AS group_id FROM f JOIN p ON p.agent_id = f.agent_id AND p.up <> f.up AND p.n <= 2 AND p.id < f.id""")
def r_s213_opposite_pairs(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "interaction_log").select("agent_id", "id", (F.col("toxicity_score") * 2 - 1).alias("valence"))
    return scoring.opposite_pairs(log, "agent_id", "id", "valence")


@query("SELECT agent_id, id, rank FROM (SELECT agent_id, id, row_number() OVER (PARTITION BY agent_id ORDER BY round(toxicity_score, 2) DESC NULLS LAST, id) AS rank FROM interaction_log) WHERE rank <= 7")
def r_w11_weight_rank(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "interaction_log").select("agent_id", "id", F.coalesce(F.round("toxicity_score", 2), F.lit(-1.0)).alias("w"))
    return scoring.active_rank(log, "agent_id", "id", "w", 7).select("agent_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT id, CASE WHEN content IS NULL THEN NULL ELSE 1536 END::int AS size, CASE WHEN content IS NULL THEN NULL ELSE 153.6 END::double AS total FROM records_v1")
def r_x19_fixed_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = _records(spark, d).select("id", scoring.fixed_embedding(F.col("content")).alias("v"))
    return v.select("id", F.when(F.col("v").isNotNull(), F.size("v")).alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("WITH g AS (SELECT id, lower(content) AS c FROM records_v1 WHERE length(content) >= 3) SELECT gram, count(DISTINCT id) AS df FROM (SELECT id, unnest(list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3))) AS gram FROM g) GROUP BY gram")
def r_s16_rebuilt_index(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "index")
    lexical.rebuild(_records(spark, d), "id", "content", path)
    return spark.read.parquet(path).groupBy("gram").agg(F.count("*").alias("df"))


@query("WITH r AS (SELECT record_id, count(*) AS n FROM records_v1 WHERE record_id IS NOT NULL GROUP BY 1) SELECT 'new' AS status, count(*)::bigint AS added, 0::bigint AS skipped FROM r UNION ALL SELECT 'replay', 0, count(*)::bigint FROM r UNION ALL SELECT 'conflict', 0, 0")
def r_e18_import_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The same batch twice, then under its name with other inputs."""
    r = _records(spark, d).filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min_by("content", "id").alias("content")).withColumn("content_sha256", F.sha2(F.coalesce("content", F.lit("")), 256))
    book, rows = ledger.Ledger(spark, scratch_path(spark, "ledger")), []
    for _ in range(2):
        done = book.take_in("records", "archive", r)
        rows.append((done["status"], done["added"], done["skipped"]))
    try:
        book.take_in("records", "archive", r.withColumn("content_sha256", F.lit("x")))
    except ledger.BatchConflict:
        rows.append(("conflict", 0, 0))
    return spark.createDataFrame(rows, "status string, added bigint, skipped bigint")


@query("WITH e AS (SELECT DISTINCT record_rowid, branch_id, position FROM records_v1_branch_memberships), n AS (SELECT DISTINCT record_rowid, branch_id, position + (record_rowid % 9 = 0)::int AS position FROM records_v1_branch_memberships) SELECT n.record_rowid AS record_id, n.branch_id, n.position, e.position AS known FROM n JOIN e ON e.record_rowid = n.record_rowid AND e.branch_id = n.branch_id WHERE n.position <> e.position")
def r_j15_membership_conflicts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").select(F.col("record_rowid").alias("record_id"), "branch_id", "position")
    return packages.membership_conflicts(m.withColumn("position", F.col("position") + (F.col("record_id") % 9 == 0).cast("int")), m)


# What older queries say less of, or can't fail on ------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT snapshot_id, unnest(json_extract(h, '$.turns[*]')) AS t FROM (SELECT snapshot_id, unnest(json_extract(threads, '$[*]')) AS h FROM codex_rollout_v1 WHERE json_valid(threads))), i AS (SELECT snapshot_id, unnest(json_extract(t, '$.items[*]')) AS i FROM t)
SELECT snapshot_id, json_extract_string(i, '$.id') AS message_id, CASE json_extract_string(i, '$.type') WHEN 'userMessage' THEN 'user' ELSE 'assistant' END AS role,
sha256(CASE json_extract_string(i, '$.type') WHEN 'userMessage' THEN coalesce(array_to_string(list_filter(list_transform(json_extract(i, '$.content[*]'), lambda p: json_extract_string(p, '$.text')), lambda s: s IS NOT NULL), chr(10)), '') ELSE coalesce(json_extract_string(i, '$.text'), '') END) AS said FROM i WHERE json_extract_string(i, '$.type') IN ('userMessage', 'agentMessage')""")
def r_s07_rollout_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every message of the rollouts with a hash of its whole text."""
    m = packages.rollout_messages(table(spark, d, "codex_rollout_v1"))
    return m.select("snapshot_id", "message_id", "role", F.sha2(F.coalesce("content", F.lit("")), 256).alias("said"))


@query("SELECT count(*) AS n_records, count(DISTINCT conversation_id) AS n_conversations, count(*) FILTER (WHERE verified) AS n_verified FROM records_v1")
def r_g20_s10_preflight(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("branch_memberships", F.lit(None).cast("array<struct<branch_id:string,position:int>>"))
    return packages.preflight(r).drop("n_errors")


@query("SELECT id FROM records_v1 WHERE imported_at >= TIMESTAMP '2025-03-31 16:00:00' AND imported_at < TIMESTAMP '2025-04-30 16:00:00'")
def r_n19_scoped_records(spark: SparkSession, d: str) -> DataFrame:
    """'last month' asked in May 2025; most records lie outside."""
    from datetime import datetime, timezone

    from recallspark.plans.planner import calendar_scope

    scope = calendar_scope("what happened last month", datetime(2025, 5, 10, tzinfo=timezone.utc))
    low, high = (F.lit(x.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") for x in (scope.start, scope.end))
    return _records(spark, d).filter((F.col("imported_at") >= low) & (F.col("imported_at") < high)).select("id")


@query("""WITH m AS (SELECT id, imported_at, verified, lower(trim(unnest(regexp_extract_all(content, '([A-Z]{3,6})-[0-9a-z]{8}', 1)))) AS name FROM records_v1), r AS (SELECT name, id::varchar AS k, row_number() OVER (PARTITION BY name ORDER BY id::varchar) AS n FROM (SELECT DISTINCT name, id FROM m))
SELECT name, coalesce(bool_or(verified), false) AS confirmed, min(imported_at) AS first_at, max(imported_at) AS last_at, count(*) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM r WHERE r.name = m.name AND r.n <= 4) AS ids FROM m GROUP BY 1""")
def r_g08_named_codes(spark: SparkSession, d: str) -> DataFrame:
    m = _records(spark, d).select("id", "imported_at", "verified", F.explode(collections.extract_names(F.col("content"), "([A-Z]{3,6})-[0-9a-z]{8}")).alias("name"))
    return collections.named_items(m, "name", "id", "imported_at", "verified")


@query(f"""WITH m AS (SELECT DISTINCT record_rowid, branch_id, position FROM records_v1_branch_memberships WHERE position IS NOT NULL), j AS (SELECT m.record_rowid, m.branch_id, m.position, coalesce(contains({_LC}, 'bridge'), false) AS anchor, coalesce(contains({_LC}, 'bridge') AND (contains({_LC}, 'kept') OR contains({_LC}, 'said')), false) AND NOT coalesce(contains({_LC}, '?'), false) AS ev FROM m JOIN records_v1 r ON r.id = m.record_rowid)
SELECT branch_id, hit, position, first_event FROM (SELECT h.branch_id, h.record_rowid AS hit, h.position, arg_min(n.record_rowid, (n.position, n.record_rowid)) FILTER (WHERE n.ev) AS first_event FROM j h JOIN j n ON n.branch_id = h.branch_id AND n.position BETWEEN h.position - 6 AND h.position + 4 WHERE h.anchor GROUP BY ALL) WHERE first_event IS NOT NULL""")
def r_j03_x12_first_events(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").filter(F.col("position").isNotNull()).distinct()
    rows, c = m.join(_records(spark, d).select(F.col("id").alias("record_rowid"), "content"), "record_rowid"), F.col("content")
    return context.event_windows(rows, tx.like_contains(c, "bridge"), lexical.any_term(c, ["kept", "said"]), F.contains(c, F.lit("?"))).select("branch_id", "hit", "position", "first_event")


def _streamed(spark: SparkSession, rows: DataFrame, view, mode: str, label: str) -> DataFrame:
    """The result of a streaming view over rows that arrive in one micro-batch, as a table written in the shared folder."""
    source, target, state = (scratch_path(spark, f"{label}-{part}") for part in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = view(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))
    writer = stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}"))
    writer.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("batch")


@query("SELECT agent_id, round(1 + 0.2 * coalesce(avg(toxicity_score), 0), 6) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY id DESC) AS n FROM interaction_log WHERE agent_id IS NOT NULL) WHERE n <= 10 GROUP BY 1")
def r_st06_streamed_factor(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "interaction_log").filter(F.col("agent_id").isNotNull()).select("agent_id", "id", "toxicity_score")
    out = _streamed(spark, log, lambda s: views.rolling_factor(s, "agent_id", "id", "toxicity_score"), "update", "factor")
    return out.select("agent_id", F.round("factor", 6).alias("factor"))


@query(f"WITH {_EVENTS} SELECT record, owner, shared, epoch FROM st")
def r_st05_streamed_states(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, _events(spark, d), views.record_states, "update", "states")


@query("SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def r_st01_streamed_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept of each user's events that arrive twice."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = _streamed(spark, e.unionByName(e), lambda s: views.append_once(s, "event_id", "ts", "3650 days"), "append", "log")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE m AS (SELECT backup_id, m.conversationId AS cid, m.sourceMessageId AS mid, m.parentSourceMessageId AS parent FROM (SELECT backup_id, unnest(data.messages) AS m FROM room_ferry_backup_v1) WHERE m IS NOT NULL),
c AS (SELECT backup_id, c.id AS cid, c.currentLeafSourceMessageId AS leaf FROM (SELECT backup_id, unnest(data.conversations) AS c FROM room_ferry_backup_v1) WHERE c IS NOT NULL),
n AS (SELECT backup_id, cid, mid, min(parent) AS parent FROM m WHERE mid IS NOT NULL GROUP BY ALL),
t AS (SELECT n.*, 0 AS depth FROM n LEFT JOIN n p ON p.backup_id = n.backup_id AND p.cid = n.cid AND p.mid = n.parent WHERE p.mid IS NULL UNION ALL SELECT n.*, t.depth + 1 FROM n JOIN t ON t.backup_id = n.backup_id AND t.cid = n.cid AND t.mid = n.parent)
SELECT backup_id, cid AS conversation_id, problem, count(*) AS n FROM (
SELECT m.backup_id, m.cid, 'unlisted_conversation' AS problem FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.backup_id = m.backup_id AND c.cid = m.cid)
UNION ALL SELECT backup_id, cid, 'repeated_message' FROM (SELECT backup_id, cid, row_number() OVER (PARTITION BY backup_id, cid, mid) AS k FROM m WHERE mid IS NOT NULL) WHERE k > 1
UNION ALL SELECT backup_id, cid, 'missing_parent' FROM t WHERE depth = 0 AND parent IS NOT NULL
UNION ALL SELECT backup_id, cid, 'endless_chain' FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.backup_id = n.backup_id AND t.cid = n.cid AND t.mid = n.mid)
UNION ALL SELECT backup_id, cid, 'unknown_leaf' FROM c WHERE leaf IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.backup_id = c.backup_id AND n.cid = c.cid AND n.mid = c.leaf)) GROUP BY ALL""")
def r_s05_backup_problems(spark: SparkSession, d: str) -> DataFrame:
    return exports.backup_problems(table(spark, d, "room_ferry_backup_v1"))


@query(f"""WITH m AS (SELECT DISTINCT record_rowid, branch_id, position FROM records_v1_branch_memberships WHERE position IS NOT NULL), j AS (SELECT DISTINCT h.branch_id, h.position, h.record_rowid AS hit, n.record_rowid AS near, n.position AS near_position FROM m h JOIN records_v1 r ON r.id = h.record_rowid AND contains({_LC}, 'ledger') JOIN m n ON n.branch_id = h.branch_id AND n.position BETWEEN h.position - 2 AND h.position + 4 AND n.record_rowid <> h.record_rowid)
SELECT branch_id, position, hit, near, near_position, place FROM (SELECT *, row_number() OVER (PARTITION BY branch_id, position, hit ORDER BY abs(near_position - position), near_position, near) AS place FROM j) WHERE place <= 4""")
def r_w02_capped_context(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").distinct()
    hit = _records(spark, d).filter(tx.like_contains(F.col("content"), "ledger")).select(F.col("id").alias("record_rowid"))
    return context.capped(context.window_join(m.join(hit, "record_rowid"), m, 2, 4), 4).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH e AS (SELECT coalesce(strftime(logged_at + INTERVAL 8 HOUR, '%Y-%m-%d'), 'record:' || id) AS day, id, logged_at FROM interaction_log), g AS (SELECT day, count(*) AS n, min(logged_at) AS first, min(id) AS k FROM e GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY first NULLS LAST, k) AS place FROM g),
i AS (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY id) AS i FROM e) SELECT p.day, p.n, (SELECT string_agg(id::varchar, ',' ORDER BY i) FROM i WHERE i.day = p.day AND i <= 24) AS ids, place FROM p WHERE place <= 12""")
def r_g07_occurrence_groups(spark: SparkSession, d: str) -> DataFrame:
    return collections.occurrence_groups(table(spark, d, "interaction_log"), "id", "logged_at").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT source_kind, authority, count(*) AS n_records, count(DISTINCT r.id) AS n_ids, count(DISTINCT conversation_id) AS n_conversations, count(g.key) AS n_mirrored FROM records_v1 r LEFT JOIN (SELECT id AS key FROM records_v1 WHERE content_sha256 IN (SELECT content_sha256 FROM records_v1 GROUP BY 1 HAVING count(*) > 1)) g ON g.key = r.id GROUP BY 1, 2")
def r_m04_provenance_packet(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    groups = claims.duplicate_hashes(r, "content_sha256").select(F.col("content_sha256").alias("group_id")).join(r.select(F.col("content_sha256").alias("group_id"), F.col("id").alias("key")), "group_id")
    return collections.provenance_packet(r, ["source_kind", "authority"], "id", "conversation_id", groups)


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' END AS status, list_filter([CASE WHEN contains(text, 'bad') THEN 'bad' END, CASE WHEN contains(text, 'late') THEN 'late' END], lambda x: x IS NOT NULL) AS families, [source] AS layers FROM documents)
SELECT counter, name, count(*) AS n FROM (SELECT 'status' AS counter, coalesce(status, 'open') AS name FROM c UNION ALL SELECT 'family', unnest(families) FROM c UNION ALL SELECT 'layer', unnest(layers) FROM c) GROUP BY 1, 2""")
def r_g11_case_report(spark: SparkSession, d: str) -> DataFrame:
    text, i = F.col("text"), F.col("doc_id") % 3
    found = F.filter(F.array(*[F.when(F.contains(text, F.lit(w)), w) for w in ("bad", "late")]), lambda x: x.isNotNull())
    cards = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.when(i == 0, "open").when(i == 1, "fixed").alias("status"), found.alias("families"), F.array("source").alias("layers"))
    return regression.report(cards)


@query("""WITH g AS (SELECT snapshot_id, message_index + (message_key % 11 = 0)::int AS message_index, CASE WHEN message_key % 29 > 0 THEN content_hash END AS content_hash FROM guijian_message), s AS (SELECT snapshot_id, message_index AS p, count(DISTINCT content_hash) AS c, count(*) FILTER (WHERE content_hash IS NULL) AS bare FROM g GROUP BY 1, 2), w AS (SELECT snapshot_id, sum(bare) AS bare, max(c) AS c, count(p) AS n, min(p) AS low, max(p) AS high FROM s GROUP BY 1)
SELECT snapshot_id, 'no_hash' AS problem FROM w WHERE bare > 0 UNION ALL SELECT snapshot_id, 'gap' FROM w WHERE high - low + 1 > n UNION ALL SELECT snapshot_id, 'clash' FROM w WHERE c > 1""")
def r_s08_capture_problems(spark: SparkSession, d: str) -> DataFrame:
    """Captures with some places moved and some hashes left out, as those of the table are complete."""
    g, k = table(spark, d, "guijian_message"), F.col("message_key")
    return captures.attested(g.withColumns({"message_index": F.col("message_index") + (k % 11 == 0).cast("int"), "content_hash": F.when(k % 29 > 0, F.col("content_hash"))}), "snapshot_id", "message_index", "content_hash")


@query()
def r_u08_dominant_segments(spark: SparkSession, d: str) -> DataFrame:
    return captures.dominant_segment(table(spark, d, "guijian_message"), "snapshot_id", "segment_index", "message_index", "content_hash")


# SQL of queries that stand elsewhere ---------------------------------------------------------------------------------------------------

_AT = f"x AS ({instants_sql(every=True)})"
_CUT = f"{_AT}, c AS (SELECT r.*, x.utc_micros AS cut, epoch_us(imported_at) AS seen FROM records_v1 r LEFT JOIN x ON x.src = 'records_v1' AND x.row_id = r.id AND x.field = 'source_cutoff_at')"
_SQL["r_g01_coverage_instants"] = f"""WITH {_CUT}, a AS (SELECT max(CASE WHEN verified AND source_kind <> 'recent_patch' THEN cut END) AS verified_cutoff, max(seen) AS last_at, count(*) AS n_records, max(CASE WHEN source_kind = 'recent_patch' THEN seen END) AS patch FROM c)
SELECT verified_cutoff, last_at, n_records, coalesce(patch > verified_cutoff OR (patch IS NOT NULL AND verified_cutoff IS NULL), false) AS has_recent_patch FROM a"""
_SQL["r_m16_coverage_ladder_instants"] = f"""WITH {_CUT} SELECT state, count(*) AS n FROM (SELECT CASE WHEN cut IS NULL THEN 'verified_cutoff_unknown' WHEN epoch_us(TIMESTAMP '2024-06-01') > cut THEN 'outside_verified_cutoff' ELSE 'within_verified_cutoff' END AS state FROM (SELECT conversation_id, max(CASE WHEN verified THEN cut END) AS cut FROM c GROUP BY 1)) GROUP BY 1"""
_SQL["r_g14_first_mention"] = f"""WITH {_AT} SELECT min(utc_micros) AS first_micros, count(*) FILTER (WHERE utc_micros IS NULL) AS n_without FROM guijian_message g LEFT JOIN x ON x.src = 'guijian_message' AND x.row_id = g.message_key"""


def _rules(column: str, rules: dict[str, str]) -> list[tuple[str, str]]:
    """The rules for the other engine, whose word boundaries know ASCII letters only."""
    edge = r"[^\p{L}\p{N}_]"
    rules = {name: rule.replace(r"\b(", f"(?:^|{edge})(").replace(r")\b", f")(?:$|{edge})") for name, rule in rules.items()}
    return [(name, f"regexp_matches({column}, '{rule.replace(chr(39), chr(39) * 2)}')") for name, rule in rules.items()]


_SQL["r_m07_all_labels"] = "SELECT id, CASE WHEN len(l) = 0 THEN 'direct' ELSE array_to_string(l, ',') END AS label FROM (SELECT id, list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _rules("coalesce(content, '')", collections.LABELS)) + "], lambda x: x IS NOT NULL) AS l FROM records_v1)"
_SQL["r_x13_all_exclusions"] = "SELECT id, CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in _rules("content", events.EXCLUSIONS)) + " END AS reason FROM records_v1 WHERE content IS NOT NULL"
