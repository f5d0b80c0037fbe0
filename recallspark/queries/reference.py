"""Queries of the engine's own operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.functions import text as tx
from recallspark.operators import claims, collections, context, events, lexical, regression, scoring, timestamps, visibility
from recallspark.session import table
from recallspark.sources import captures, packages

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _role(c: str = "role") -> str:
    return f"lower(trim({c}))"


# Views shared by both engines ---------------------------------------------------------------------------------------

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LC = _LOW.format("content")
_PHASE = "CASE WHEN source_kind IN ('official-zip','agent-log') THEN CASE WHEN contains(source_ref,'phase=final_answer') THEN 'final_answer' WHEN contains(source_ref,'phase=commentary') THEN 'commentary' WHEN contains(source_ref,'phase=thoughts') THEN 'thoughts' WHEN contains(source_ref,'phase=reasoning_recap') THEN 'reasoning_recap' END END"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records_v1")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Visibility events made of the event stream; a revoke targets the latest grant of its record before it."""
    e = table(spark, d, "events")
    kinds = F.create_map(*[F.lit(x) for pair in (("signup", "set_owner"), ("view", "scope_shared"), ("purchase", "scope_private"), ("click", "grant"), ("error", "revoke")) for x in pair])
    v = e.select((F.col("event_id") + 1).alias("event_seq"), F.col("user_id").alias("record"), F.element_at(kinds, F.col("event_type")).alias("event_kind"), F.concat(F.lit("agt-"), F.col("event_id") % 7).alias("agent"))
    before = Window.partitionBy("record").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_kind") == "grant", F.col("event_seq"))).over(before)
    v = v.withColumn("target_event_seq", F.when(F.col("event_kind") == "revoke", last))
    return v.select("event_seq", "record", "event_kind", F.when(F.col("event_kind").isin("set_owner", "grant"), F.col("agent")).alias("target_agent"), "target_event_seq")


_EVENTS = """v0 AS (SELECT event_id + 1 AS event_seq, user_id AS record, CASE event_type WHEN 'signup' THEN 'set_owner' WHEN 'view' THEN 'scope_shared' WHEN 'purchase' THEN 'scope_private' WHEN 'click' THEN 'grant' WHEN 'error' THEN 'revoke' END AS event_kind, concat('agt-', event_id % 7) AS agent FROM events),
v AS (SELECT event_seq, record, event_kind, CASE WHEN event_kind IN ('set_owner','grant') THEN agent END AS target_agent, CASE WHEN event_kind = 'revoke' THEN max(CASE WHEN event_kind = 'grant' THEN event_seq END) OVER (PARTITION BY record ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target_event_seq FROM v0),
st AS (SELECT record, coalesce(arg_max(target_agent, event_seq) FILTER (WHERE event_kind = 'set_owner'), 'anchor') AS owner, coalesce(arg_max(event_kind, event_seq) FILTER (WHERE event_kind IN ('scope_private','scope_shared')) = 'scope_shared', false) AS shared, coalesce(max(event_seq) FILTER (WHERE event_kind IN ('set_owner','scope_private')), 0) AS epoch FROM v GROUP BY record),
lg AS (SELECT DISTINCT g.record, g.target_agent AS agent FROM v g JOIN st USING (record) WHERE g.event_kind = 'grant' AND g.event_seq > st.epoch AND NOT EXISTS (SELECT 1 FROM v r WHERE r.event_kind = 'revoke' AND r.target_event_seq = g.event_seq))"""


# Predicates and projections -------------------------------------------------------------------------------------------


@query(f"SELECT id, length(content) AS n FROM records_v1 WHERE contains({_LC}, 'the ledger')")
def r_p01_ascii_fold_like(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r.filter(tx.like_contains(F.col("content"), "The Ledger")).select("id", F.length("content").cast("bigint").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'")
def r_p02_half_open_range(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter((F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))).select("event_id", "event_type")


@query("SELECT id, role FROM records_v1 WHERE role IN ('user', 'system')")
def r_p03_role_filter(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(F.col("role").isin("user", "system")).select("id", "role")


@query(f"SELECT id FROM records_v1 WHERE contains({_LC}, 'ledger') AND contains({_LC}, 'harbour')")
def r_p04_required_all(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(lexical.all_terms(F.col("content"), ["ledger", "harbour"])).select("id")


@query(f"SELECT id FROM records_v1 WHERE (contains({_LC}, 'ledger'))::int + (contains({_LC}, 'window'))::int + (contains({_LC}, 'bridge'))::int >= 2")
def r_p05_min_any_match(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(lexical.at_least(F.col("content"), ["ledger", "window", "bridge"], 2)).select("id")


@query(f"SELECT id FROM records_v1 WHERE contains({_LC}, 'laterne') OR contains({_LC}, 'lanterne')")
def r_p06_any_term(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(lexical.any_term(F.col("content"), ["Laterne", "lanterne"])).select("id")


@query("SELECT id, agent_id FROM interaction_log WHERE agent_id = 'agt-01' AND toxicity_score > 0.5")
def r_p08_equality_filters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interaction_log").filter((F.col("agent_id") == "agt-01") & (F.col("toxicity_score") > 0.5)).select("id", "agent_id")


_REF = "concat('zip://x?phase=', CASE id % 3 WHEN 0 THEN 'final_answer' WHEN 1 THEN 'commentary' ELSE 'none' END)"


def _phased(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("zip://x?phase="), F.when(F.col("id") % 3 == 0, "final_answer").when(F.col("id") % 3 == 1, "commentary").otherwise("none"))
    return _records(spark, d).withColumn("source_ref", ref)


@query(f"SELECT id, phase, CASE WHEN phase = 'final_answer' THEN 2 WHEN phase IS NULL THEN 1 ELSE 0 END AS priority FROM (SELECT id, {_PHASE.replace('source_ref', _REF)} AS phase FROM records_v1)")
def r_p09_p10_phase_priority(spark: SparkSession, d: str) -> DataFrame:
    p = _phased(spark, d).select("id", lexical.phase(F.col("source_kind"), F.col("source_ref")).alias("phase"))
    return p.select("id", "phase", lexical.phase_priority(F.col("phase")).alias("priority"))


@query("SELECT id, CASE WHEN length(content) > 280 THEN concat(substring(content, 1, 280), '…') ELSE content END AS short FROM records_v1")
def r_p11_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", tx.truncate(F.col("content"), 280).alias("short"))


@query("SELECT id, round(least(0.5 + CASE WHEN contains(content, 'the ledger') THEN 0.2 ELSE 0 END + CASE WHEN verified THEN 0.15 ELSE 0 END + CASE WHEN authority = 'official' THEN 0.1 ELSE 0 END + CASE WHEN length(source_ref) > 0 THEN 0.05 ELSE 0 END, 1.0), 2)::double AS confidence FROM records_v1")
def r_p12_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", lexical.confidence(F.col("content"), "the ledger", F.col("verified"), F.col("authority"), F.col("source_ref")).alias("confidence"))


@query("SELECT id, substring(content_sha256, 1, 12) AS fingerprint FROM records_v1")
def r_p14_redacted_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", F.substring("content_sha256", 1, 12).alias("fingerprint"))


@query("SELECT id, CASE WHEN source_kind IN ('official-zip','tree-backup') THEN 'chat' WHEN source_kind = 'agent-log' THEN 'agent' ELSE 'other' END AS channel FROM records_v1")
def r_p15_channel(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("source_kind")
    return _records(spark, d).select("id", F.when(kind.isin("official-zip", "tree-backup"), "chat").when(kind == "agent-log", "agent").otherwise("other").alias("channel"))


# Search and ranks -----------------------------------------------------------------------------------------------------

_SCORED = f"s AS (SELECT id, imported_at, length(content) AS n, source_kind, (contains({_LC}, 'ledger'))::int + (contains({_LC}, 'window'))::int + (contains({_LC}, 'bridge'))::int AS score, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS phase FROM records_v1)"
_ORDER_SQL = {
    "like": "score DESC, phase DESC, imported_at DESC, id", "relevance_oldest": "score DESC, phase DESC, imported_at, n, id", "oldest": "imported_at, score DESC, phase DESC, n, id",
    "latest": "imported_at DESC, score DESC, phase DESC, n, id", "compact": "n, score DESC, phase DESC, imported_at DESC, id", "default": "score DESC, phase DESC, n, imported_at DESC, id", "trace": "imported_at, score DESC, n, id",
}


def _ranked(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _records(spark, d).select("id", "imported_at", "content", "source_kind", lexical.term_score(F.col("content"), ["ledger", "window", "bridge"]).alias("score"), F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 3 == 1, 0).otherwise(1).alias("phase"))
        order = lexical.order_by(name, "imported_at", "content", "id")
        return lexical.top_k(r.filter("score > 0"), order, 20, ["source_kind"]).select("source_kind", "id", F.col("rank").cast("bigint").alias("rank"))

    run.__name__ = f"r_o_rank_{name}"
    return run


for _name, _o in _ORDER_SQL.items():
    query(f"WITH {_SCORED} SELECT source_kind, id, rank FROM (SELECT source_kind, id, row_number() OVER (PARTITION BY source_kind ORDER BY {_o}) AS rank FROM s WHERE score > 0) WHERE rank <= 20")(_ranked(_name))


@query("SELECT role_, id, candidate FROM (SELECT lower(trim(role)) AS role_, id, row_number() OVER (PARTITION BY lower(trim(role)) ORDER BY (conflict_group_id IS NULL)::int, imported_at, id) AS candidate FROM records_v1) WHERE candidate <= 200")
def r_o09_bounded_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select(F.lower(F.trim("role")).alias("role_"), "id", "imported_at", F.col("conflict_group_id").isNull().cast("int").alias("later"))
    top = lexical.top_k(r, [F.col("later").asc(), F.col("imported_at").asc(), F.col("id").asc()], 200, ["role_"])
    return top.select("role_", "id", F.col("rank").cast("bigint").alias("candidate"))


@query("SELECT id FROM records_v1 WHERE contains(lower(content), 'pierre') OR contains(lower(content), 'été')")
def r_x02_phrase(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _records(spark, d).filter(tx.phrase_contains(c, "Pierre") | tx.phrase_contains(c, "ÉTÉ")).select("id")


@query("SELECT id FROM records_v1 WHERE contains(lower(content), 'ledger') AND contains(lower(content), 'keeper') AND (contains(lower(content), 'tower') OR contains(lower(content), 'bridge'))")
def r_x04_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(lexical.relaxed(F.col("content"), ["ledger", "keeper"], ["tower", "bridge"])).select("id")


@query("""WITH d AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM documents),
c AS (SELECT doc_id, len, (length(t) - length(replace(t, 'harbour', ''))) // 7 AS f0, (length(t) - length(replace(t, 'ledger', ''))) // 6 AS f1 FROM d),
s AS (SELECT count(*) AS n, avg(len) AS a, sum((f0 > 0)::int) AS d0, sum((f1 > 0)::int) AS d1 FROM c)
SELECT doc_id, score, rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM (SELECT doc_id, round(
 - (CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d0 + 0.5) / (d0 + 0.5)) END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a))
 - (CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score FROM c, s WHERE f0 > 0 OR f1 > 0)) WHERE rank <= 20""")
def r_x05_bm25_top20(spark: SparkSession, d: str) -> DataFrame:
    scored = lexical.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["harbour", "ledger"]).select("doc_id", F.round("score", 6).alias("score"))
    return lexical.top_k(scored, [F.col("score").asc(), F.col("doc_id").asc()], 20).select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("WITH g AS (SELECT id, lower(content) AS c FROM records_v1 WHERE length(content) >= 3) SELECT gram, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest(list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3))) AS gram FROM g) GROUP BY gram")
def r_x01_trigram_index(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.postings(_records(spark, d), "id", "content")
    return index.groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("SELECT id AS key, (length(lower(content)) - length(replace(lower(content), 'signal tower', ''))) // 12 AS n FROM records_v1 WHERE contains(lower(content), 'signal tower')")
def r_s04_index_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.postings(_records(spark, d), "id", "content")
    return lexical.search_postings(index, "signal tower").select("key", F.col("n").cast("bigint").alias("n"))


@query(f"SELECT id, (contains({_LC}, 'ledger'))::int + (contains({_LC}, 'window'))::int + (contains({_LC}, 'bridge') OR contains({_LC}, 'tower'))::int * 1 + 3 * (contains({_LC}, 'signal'))::int AS score FROM records_v1")
def r_x08_intent_score(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _records(spark, d).select("id", F.coalesce(lexical.intent_score(c, required=["ledger"], any_of=["bridge", "tower"], bonus=["window"], priority=["signal"], weight=3, as_group=True)).alias("score"))


@query("""WITH q AS (SELECT item_id, lower(substring(item_text, 1, 40)) AS probe FROM eval_items) SELECT item_id, count(doc_id) AS df FROM q LEFT JOIN documents ON contains(lower(text), probe) GROUP BY item_id HAVING count(doc_id) >= 2""")
def r_g03_x09_anchor_df(spark: SparkSession, d: str) -> DataFrame:
    """Literal anchors that at least two documents have; the anchors are a fixed, small set."""
    probes = table(spark, d, "eval_items").select("item_id", F.lower(F.substring("item_text", 1, 40)).alias("probe"))
    docs = table(spark, d, "documents").select(F.lower("text").alias("low"))
    return docs.join(F.broadcast(probes), F.contains("low", "probe")).groupBy("item_id").agg(F.count("*").alias("df")).filter("df >= 2")


@query("""SELECT item_id, count(doc_id) AS df FROM eval_items LEFT JOIN documents ON contains(lower(text), lower(item_text)) GROUP BY item_id HAVING count(doc_id) >= 2""")
def r_g03_x09_passage_df(spark: SparkSession, d: str) -> DataFrame:
    """Whole passages that at least two documents have; r_g03_x09_anchor_df looks for their first 40 characters only."""
    passages = table(spark, d, "eval_items").select("item_id", F.lower("item_text").alias("passage"))
    docs = table(spark, d, "documents").select(F.lower("text").alias("low"))
    return docs.join(F.broadcast(passages), F.contains("low", "passage")).groupBy("item_id").agg(F.count("*").alias("df")).filter("df >= 2")


_QUESTIONS = [("q1", "the glass bridge", [], ["bridge", "glass"]), ("q2", "", ["harbour", "ledger"], []), ("q3", "no such wording at all", [], ["lantern", "violin"]), ("q4", "die langen lieder", [], ["lieder", "anker"]), ("q5", "", ["zzz-none"], ["the"])]


@query(f"""WITH q(question_id, literal, anchors, any_terms) AS (VALUES {", ".join(f"('{a}', '{b}', {c}::varchar[], {e}::varchar[])" for a, b, c, e in _QUESTIONS)}),
r AS (SELECT id AS key, {_LC} AS low FROM records_v1),
h AS (SELECT question_id, key, len(list_filter(any_terms, lambda x: contains(low, x))) + len(list_filter(anchors, lambda x: contains(low, x))) AS score,
 CASE WHEN len(anchors) > 0 AND len(list_filter(anchors, lambda x: contains(low, x))) = len(anchors) THEN 0 WHEN len(anchors) > 0 THEN NULL WHEN length(literal) >= 3 AND contains(low, literal) THEN 1
 WHEN len(any_terms) > 0 AND len(list_filter(any_terms, lambda x: contains(low, x))) = len(any_terms) THEN 2 WHEN len(list_filter(any_terms, lambda x: contains(low, x))) > 0 THEN 3 END AS tier FROM r, q),
b AS (SELECT question_id, min(tier) AS tier FROM h GROUP BY 1)
SELECT question_id, key, tier, score, rank FROM (SELECT h.question_id, h.key, h.tier, h.score, row_number() OVER (PARTITION BY h.question_id ORDER BY h.score DESC, h.key) AS rank FROM h JOIN b ON h.question_id = b.question_id AND h.tier = b.tier) WHERE rank <= 10""")
def r_x10_tier_cascade(spark: SparkSession, d: str) -> DataFrame:
    questions = spark.createDataFrame(_QUESTIONS, "question_id string, literal string, anchors array<string>, any_terms array<string>")
    return lexical.cascade(_records(spark, d), "id", "content", questions).select("question_id", "key", F.col("tier").alias("tier"), F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH n AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), q AS (SELECT vec_id AS query, e AS qe FROM n WHERE vec_id % 20 = 0)
SELECT query, key, similarity, rank FROM (SELECT query, vec_id AS key, round(list_cosine_similarity(e, qe), 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(e, qe), 6) DESC, vec_id) AS rank FROM n, q) WHERE rank <= 10""")
def r_x18_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top 10 of every row whose id is divisible by 20, against all rows."""
    v = table(spark, d, "embeddings")
    return scoring.nearest(v, "vec_id", "embedding", v.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", 10).select("query", "key", "similarity", F.col("rank").cast("bigint").alias("rank"))


# Visibility and states --------------------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT record, owner, shared, epoch FROM st")
def r_e01_record_state(spark: SparkSession, d: str) -> DataFrame:
    return visibility.record_state(_events(spark, d))


@query(f"WITH {_EVENTS} SELECT record, agent FROM lg")
def r_e01_live_grants(spark: SparkSession, d: str) -> DataFrame:
    return visibility.live_grants(_events(spark, d))


@query(f"""WITH {_EVENTS}, a AS (SELECT DISTINCT agent FROM v0) SELECT record, agent, channel FROM (SELECT st.record, a.agent, CASE WHEN a.agent = owner THEN 'owner' WHEN shared THEN 'scope_shared' WHEN lg.agent IS NOT NULL THEN 'grant' END AS channel FROM st CROSS JOIN a LEFT JOIN lg ON lg.record = st.record AND lg.agent = a.agent) WHERE channel IS NOT NULL""")
def r_e03_channels(spark: SparkSession, d: str) -> DataFrame:
    agents = spark.createDataFrame([(f"agt-{i}",) for i in range(7)], "agent string")
    e = _events(spark, d)
    return visibility.channels(e.select("record").distinct(), e, agents)


@query(f"""WITH {_EVENTS} SELECT event_id FROM events WHERE user_id IN (SELECT record FROM st WHERE owner = 'agt-3' OR shared UNION SELECT record FROM lg WHERE agent = 'agt-3')""")
def r_e04_p07_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    return visibility.visible(table(spark, d, "events"), "user_id", _events(spark, d), "agt-3").select("event_id")


_AGENT = "CASE event_type WHEN 'signup' THEN 'registered' WHEN 'error' THEN 'disabled' WHEN 'view' THEN 're-enabled' ELSE 'noise' END"


@query(f"""WITH e AS (SELECT event_id AS event_seq, user_id AS agent, {_AGENT} AS event_kind FROM events), f AS (SELECT agent, min(event_seq) FILTER (WHERE event_kind = 'registered') AS first FROM e GROUP BY 1),
l AS (SELECT e.agent, arg_max(event_kind, event_seq) AS last FROM e JOIN f ON e.agent = f.agent AND event_seq > first WHERE event_kind IN ('disabled','re-enabled') GROUP BY 1)
SELECT f.agent, CASE WHEN first IS NULL OR last = 'disabled' THEN 'disabled' ELSE 'active' END AS state FROM f LEFT JOIN l ON f.agent = l.agent""")
def r_e05_agent_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "registered").when(F.col("event_type") == "error", "disabled").when(F.col("event_type") == "view", "re-enabled").otherwise("noise")
    return visibility.agent_state(table(spark, d, "events").select(F.col("event_id").alias("event_seq"), F.col("user_id").alias("agent"), kind.alias("event_kind")))


_CRED = "CASE WHEN event_type = 'signup' THEN 'issued' WHEN event_type = 'click' THEN 'rotated' WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'revoked' WHEN event_type = 'error' AND event_id % 13 = 0 THEN 'expired' ELSE 'issued' END"


@query(f"""WITH e AS (SELECT event_id AS seq, user_id AS credential, {_CRED} AS kind FROM events) SELECT credential, coalesce(arg_min(kind, seq) FILTER (WHERE kind IN ('revoked','expired')), CASE WHEN arg_max(kind, seq) = 'issued' THEN 'active' ELSE arg_max(kind, seq) END) AS state, coalesce(min(seq) FILTER (WHERE kind IN ('revoked','expired')), max(seq)) AS since FROM e GROUP BY 1""")
def r_e06_credential_state(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "signup", "issued").when(t == "click", "rotated").when((t == "error") & (i % 11 == 0), "revoked").when((t == "error") & (i % 13 == 0), "expired").otherwise("issued")
    return visibility.credential_state(table(spark, d, "events").select(i.alias("event_seq"), F.col("user_id").alias("credential"), kind.alias("event_kind")))


_DECISION = "CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'stale' WHEN 'view' THEN 'unresolved' END"


@query(f"""WITH d AS (SELECT user_id AS conflict_id, event_id AS seq, {_DECISION} AS decision FROM events WHERE event_type IN ('purchase','error','view')), l AS (SELECT conflict_id, arg_max(decision, seq) AS last FROM d GROUP BY 1)
SELECT c.user_id AS conflict_id, CASE WHEN last IS NULL OR last = 'unresolved' THEN 'open' ELSE last END AS status FROM (SELECT DISTINCT user_id FROM events) c LEFT JOIN l ON l.conflict_id = c.user_id""")
def r_e08_conflict_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    decisions = e.filter(t.isin("purchase", "error", "view")).select(F.col("user_id").alias("conflict_id"), F.col("event_id").alias("seq"), F.when(t == "purchase", "resolved").when(t == "error", "stale").otherwise("unresolved").alias("decision"))
    return claims.conflict_status(e.select(F.col("user_id").alias("conflict_id")), decisions)


@query("""SELECT l_orderkey AS claim, count(*) AS n_evidence, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)) AS readable FROM lineitem GROUP BY 1""")
def r_e09_claim_visible(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("record"))
    seen = table(spark, d, "part").filter(F.col("p_partkey") % 10 != 3)
    return claims.evidence_gate(evidence, "claim", "record", seen, "p_partkey")


@query("""WITH l AS (SELECT conversation_id AS claim, record_id AS record, CASE WHEN id % 97 = 0 THEN 'x' ELSE content_sha256 END AS h FROM records_v1 WHERE conflict_group_id IS NOT NULL), c AS (SELECT record_id, min(content_sha256) AS now FROM records_v1 WHERE id % 89 <> 0 GROUP BY 1),
j AS (SELECT claim, count(record) AS linked, count(now) AS found, coalesce(bool_or(h <> now), false) AS differs FROM l LEFT JOIN c ON c.record_id = l.record GROUP BY 1)
SELECT claim, CASE WHEN linked = 0 THEN 'no_evidence' WHEN found < linked THEN 'missing_evidence' WHEN differs THEN 'stale' ELSE 'fresh' END AS state FROM j""")
def r_e11_freshness(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    links = r.filter(F.col("conflict_group_id").isNotNull()).select(F.col("conversation_id").alias("claim"), F.col("record_id").alias("record"), F.when(F.col("id") % 97 == 0, "x").otherwise(F.col("content_sha256")).alias("h"))
    current = r.filter(F.col("id") % 89 != 0).groupBy("record_id").agg(F.min("content_sha256").alias("now"))
    return claims.freshness(links, "claim", "record", "h", current, "record_id", "now")


# Joins and windows ------------------------------------------------------------------------------------------------------

_M = "m AS (SELECT DISTINCT record_rowid, branch_id, position FROM records_v1_branch_memberships WHERE position IS NOT NULL)"


@query(f"""WITH {_M} SELECT DISTINCT h.branch_id, h.position, h.record_rowid AS hit, n.record_rowid AS near, n.position AS near_position FROM m h JOIN records_v1 r ON r.id = h.record_rowid AND contains({_LC}, 'ledger') JOIN m n ON n.branch_id = h.branch_id AND n.position BETWEEN h.position - 1 AND h.position + 2 AND n.record_rowid <> h.record_rowid""")
def r_j02_w02_context_window(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").distinct()
    hit = _records(spark, d).filter(tx.like_contains(F.col("content"), "ledger")).select(F.col("id").alias("record_rowid"))
    return context.window_join(m.join(hit, "record_rowid"), m, 1, 2)


@query(f"""WITH {_M}, j AS (SELECT m.record_rowid, m.branch_id, m.position, coalesce(contains({_LC}, 'bridge'), false) AS anchor, coalesce(contains({_LC}, 'bridge') AND (contains({_LC}, 'kept') OR contains({_LC}, 'said')), false) AND NOT coalesce(contains({_LC}, '?'), false) AS ev FROM m JOIN records_v1 r ON r.id = m.record_rowid)
SELECT branch_id, hit, position, n_rows, n_event_rows FROM (SELECT h.branch_id, h.record_rowid AS hit, h.position, count(*) AS n_rows, sum(n.ev::int)::bigint AS n_event_rows FROM j h JOIN j n ON n.branch_id = h.branch_id AND n.position BETWEEN h.position - 6 AND h.position + 4 WHERE h.anchor GROUP BY ALL) WHERE n_event_rows > 0""")
def r_j03_x12_event_window(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").filter(F.col("position").isNotNull()).distinct()
    rows = m.join(_records(spark, d).select(F.col("id").alias("record_rowid"), "content"), "record_rowid")
    c = F.col("content")
    return context.event_windows(rows, tx.like_contains(c, "bridge"), lexical.any_term(c, ["kept", "said"]), F.contains(c, F.lit("?"))).drop("first_event")


@query(f"""WITH {_M}, p AS (SELECT r.id, r.conversation_id, m.branch_id, m.position, lower(trim(role)) AS role, CASE WHEN lower(trim(role)) = 'assistant' THEN CASE id % 3 WHEN 0 THEN 'final_answer' ELSE 'commentary' END END AS phase FROM m JOIN records_v1 r ON r.id = m.record_rowid)
SELECT id, final_id, distance FROM (SELECT a.id, f.id AS final_id, f.position - a.position AS distance, row_number() OVER (PARTITION BY a.id ORDER BY f.position - a.position, f.id) AS rn FROM p a JOIN p f ON f.conversation_id = a.conversation_id AND f.branch_id = a.branch_id AND f.phase = 'final_answer' AND f.position > a.position AND f.position <= a.position + 4
WHERE a.phase = 'commentary' AND NOT EXISTS (SELECT 1 FROM p u WHERE u.conversation_id = a.conversation_id AND u.branch_id = a.branch_id AND u.role = 'user' AND u.position > a.position AND u.position < f.position)) WHERE rn = 1""")
def r_j17_x17_phase_bundle(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").filter(F.col("position").isNotNull()).distinct()
    role = F.lower(F.trim("role"))
    r = _records(spark, d).select("id", "conversation_id", role.alias("role"), F.when(role == "assistant", F.when(F.col("id") % 3 == 0, "final_answer").otherwise("commentary")).alias("phase"))
    return context.nearest_final(m.withColumnRenamed("record_rowid", "id").join(r, "id"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def r_j07_left_target(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, d, "customer").select("c_custkey").join(totals, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT record_rowid, branch_id FROM records_v1_branch_memberships WHERE record_rowid NOT IN (SELECT id FROM records_v1)")
def r_j08_orphans(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships")
    return claims.orphans(m, "record_rowid", _records(spark, d), "id").select("record_rowid", "branch_id")


@query("SELECT id FROM records_v1 WHERE id NOT IN (SELECT record_rowid FROM records_v1_branch_memberships)")
def r_j14_missing(spark: SparkSession, d: str) -> DataFrame:
    return claims.orphans(_records(spark, d).select("id"), "id", table(spark, d, "records_v1_branch_memberships"), "record_rowid")


@query("SELECT user_id, max(CASE WHEN rn <= 6 THEN event_id END) AS last_of_first, min(CASE WHEN rd <= 6 THEN event_id END) AS first_of_last, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rd FROM events) WHERE rn <= 6 OR rd <= 6 GROUP BY 1")
def r_w04_first_last(spark: SparkSession, d: str) -> DataFrame:
    kept = context.first_last(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])
    up, down = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    ranked = kept.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down))
    return ranked.groupBy("user_id").agg(F.max(F.when(F.col("a") <= 6, F.col("event_id"))).alias("last_of_first"), F.min(F.when(F.col("b") <= 6, F.col("event_id"))).alias("first_of_last"), F.count("*").alias("kept"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN ts END AS own, ts + INTERVAL 1 DAY AS seen FROM events), n AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e)
SELECT event_id, coalesce(own, nxt, seen) AS at, CASE WHEN own IS NOT NULL THEN 'own' WHEN nxt IS NOT NULL THEN 'next' ELSE 'observed' END AS basis FROM n""")
def r_w07_time_ladder(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("own"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("seen"))
    return context.time_ladder(e, ["user_id"], ["event_id"], "own", "seen").select("event_id", "at", "basis")


@query("SELECT agent_id, sum((logged_at < before)::int)::bigint AS breaks FROM (SELECT agent_id, logged_at, coalesce(lag(logged_at) OVER (PARTITION BY agent_id ORDER BY id), logged_at) AS before FROM interaction_log WHERE logged_at IS NOT NULL) GROUP BY 1")
def r_w08_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return context.monotonic_breaks(table(spark, d, "interaction_log"), ["agent_id"], ["id"], "logged_at")


@query("SELECT agent_id, round(1 + 0.2 * coalesce(avg(toxicity_score), 0), 6) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY logged_at DESC, id DESC) AS n FROM interaction_log) WHERE n <= 10 GROUP BY 1")
def r_g10_w10_last10_factor(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "interaction_log")
    return scoring.rolling_factor(log, "agent_id", ["logged_at", "id"], "toxicity_score").select("agent_id", F.round("factor", 6).alias("factor"))


# Aggregations, collections, claims ----------------------------------------------------------------------------------------


@query("SELECT max(CASE WHEN verified AND source_kind <> 'recent_patch' THEN source_cutoff_at END) AS verified_cutoff, max(imported_at) AS last_at, count(*) AS n_records FROM (SELECT verified, source_kind, imported_at, CASE WHEN regexp_full_match(source_cutoff_at, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN source_cutoff_at END AS source_cutoff_at FROM records_v1)")
def r_g01_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("source_cutoff_at", F.when(F.col("source_cutoff_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.col("source_cutoff_at")))
    return _coverage(r)


def _coverage(r: DataFrame) -> DataFrame:
    counted = r.withColumn("cut", F.col("source_cutoff_at")).withColumn("at", F.col("imported_at").cast("string"))
    out = claims.coverage(counted, "at", "cut", "verified", "source_kind")
    return out.select("verified_cutoff", F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n_records")


@query("SELECT source_kind, authority, verified, count(*) AS n_records, count(DISTINCT record_id) AS n_ids, count(DISTINCT conversation_id) AS n_conversations FROM records_v1 GROUP BY ALL")
def r_g05_source_summary(spark: SparkSession, d: str) -> DataFrame:
    return collections.source_summary(_records(spark, d), ["source_kind", "authority", "verified"], "record_id", "conversation_id")


@query("SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_key FROM events GROUP BY 1")
def r_g07_day_buckets(spark: SparkSession, d: str) -> DataFrame:
    return collections.occurrence_days(table(spark, d, "events"), "event_id", "ts")


@query("""WITH m AS (SELECT doc_id, captured_at, doc_kind, lower(trim(unnest(regexp_extract_all(text, '\\[([a-z]{2,16})\\]', 1)))) AS name FROM documents) SELECT name, coalesce(bool_or(doc_kind = 'claim-notes'), false) AS confirmed, min(captured_at) AS first_at, max(captured_at) AS last_at, count(*) AS n FROM m GROUP BY 1""")
def r_g08_named_items(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", "captured_at", (F.col("doc_kind") == "claim-notes").alias("ok"), F.explode(collections.extract_names(F.col("text"), r"\[([a-z]{2,16})\]")).alias("name"))
    return collections.named_items(m, "name", "doc_id", "captured_at", "ok").drop("ids")


@query("SELECT l_orderkey, sha256(concat('[', string_agg(pair, ',' ORDER BY a, b), ']')) AS set_hash FROM (SELECT DISTINCT l_orderkey, l_partkey::varchar AS a, l_suppkey::varchar AS b, concat('[\"', l_partkey, '\",\"', l_suppkey, '\"]') AS pair FROM lineitem) GROUP BY 1")
def r_g17_set_hash(spark: SparkSession, d: str) -> DataFrame:
    return claims.set_hash(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", "l_suppkey")


@query("SELECT snapshot_id, sha256(string_agg(content_hash, chr(10) ORDER BY message_index, content_hash)) AS sequence_hash FROM guijian_message WHERE content_hash IS NOT NULL GROUP BY 1")
def r_g18_sequence_hash(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "guijian_message").filter(F.col("content_hash").isNotNull())
    return claims.sequence_hash(g, ["snapshot_id"], "message_index", "content_hash")


@query("SELECT content_sha256, count(*) AS n FROM records_v1 WHERE content_sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def r_g13_duplicate_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(F.col("content_sha256").isNotNull()).groupBy("content_sha256").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT (SELECT count(*) FROM (SELECT id FROM records_v1 EXCEPT SELECT record_rowid FROM records_v1_branch_memberships)) AS missing, (SELECT count(*) FROM (SELECT record_rowid FROM records_v1_branch_memberships EXCEPT SELECT id FROM records_v1)) AS orphaned")
def r_g12_u03_index_consistency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.index_consistency(_records(spark, d), "id", table(spark, d, "records_v1_branch_memberships"), "record_rowid")


@query("SELECT record_id FROM records_v1 WHERE source_kind = 'agent-log' INTERSECT SELECT record_id FROM records_v1 WHERE verified")
def r_u04_intersection(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r.filter(F.col("source_kind") == "agent-log").select("record_id").intersect(r.filter("verified").select("record_id"))


@query("SELECT record_id, src, id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY src, id) AS rn FROM (SELECT record_id, id, 0 AS src FROM records_v1 WHERE verified UNION ALL SELECT record_id, id, 1 AS src FROM records_v1)) WHERE rn = 1")
def r_u01_ordered_union(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("record_id", "id", "verified")
    both = r.filter("verified").select("record_id", "id", F.lit(0).alias("src")).unionByName(r.select("record_id", "id", F.lit(1).alias("src")))
    return both.groupBy("record_id").agg(F.min(F.struct("src", "id")).alias("b")).select("record_id", "b.src", "b.id")


@query("SELECT doc_id, CASE WHEN k = '' THEN 0 ELSE len(list_distinct(string_split(k, ''))) END AS n FROM (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM documents)")
def r_m05_distinctive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.distinct_alnum(F.col("text")).cast("bigint").alias("n"))


@query("SELECT id, CASE WHEN contains(content, '?') OR contains(content, '？') THEN 'question' ELSE 'direct' END AS label FROM records_v1")
def r_m07_labels(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", F.when(F.col("content").isNull(), "direct").otherwise(collections.labels(F.col("content"), {"question": r"\?|？"})).alias("label"))


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS version, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1 THEN 'active' ELSE 'superseded' END AS status FROM events")
def r_k01_e14_claim_versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return claims.versions(e, ["user_id", "event_type"], ["event_id"]).withColumn("version", F.col("version").cast("bigint"))


@query("SELECT conversation_id, concat('clm-', substring(sha256(concat('[\"claim\",\"', conversation_id, '\"]')), 1, 24)) AS claim_id FROM (SELECT DISTINCT conversation_id FROM records_v1)")
def r_k02_canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("conversation_id").distinct().select("conversation_id", claims.canonical_id("clm-", F.lit("claim"), F.col("conversation_id")).alias("claim_id"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN verified_cut IS NULL THEN 'verified_cutoff_unknown' WHEN DATE '2024-06-01' > verified_cut THEN 'outside_verified_cutoff' ELSE 'within_verified_cutoff' END AS state FROM (SELECT conversation_id, max(CASE WHEN verified THEN TRY_CAST(substring(source_cutoff_at, 1, 10) AS DATE) END) AS verified_cut FROM (SELECT conversation_id, verified, CASE WHEN regexp_full_match(source_cutoff_at, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN source_cutoff_at END AS source_cutoff_at FROM records_v1) GROUP BY 1)) GROUP BY 1")
def r_m16_coverage_ladder(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.col("source_cutoff_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.substring("source_cutoff_at", 1, 10)).try_cast("date")
    each = _records(spark, d).groupBy("conversation_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("verified"), cut)).alias("cutoff"))
    return each.select(claims.coverage_state(F.col("n"), F.col("cutoff"), F.lit("2024-06-01").cast("date")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def _cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """records_v1 with the instants of source_cutoff_at (in any form) and imported_at in microseconds."""
    known = table(spark, d, "source_profiles").groupBy("source_kind").agg(F.min("zone_name").alias("_zone"), F.min("date_order").alias("_order"))
    cut = timestamps.utc_micros(F.col("source_cutoff_at"), F.col("_zone"), F.col("_order"))
    return _records(spark, d).join(known, "source_kind", "left").withColumns({"cutoff_micros": cut, "at_micros": F.unix_micros(F.col("imported_at").cast("timestamp"))})


@query()
def r_g01_coverage_instants(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by instants; r_g01_coverage knows one written form only."""
    return claims.coverage(_cutoffs(spark, d), "at_micros", "cutoff_micros", "verified", "source_kind")


@query()
def r_m16_coverage_ladder_instants(spark: SparkSession, d: str) -> DataFrame:
    """The ladder as of 2024-06-01 by instants; r_m16_coverage_ladder knows one written form only."""
    as_of = F.unix_micros(F.lit("2024-06-01T00:00:00Z").cast("timestamp"))
    each = _cutoffs(spark, d).groupBy("conversation_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("verified"), F.col("cutoff_micros"))).alias("cutoff"))
    return each.select(claims.coverage_state(F.col("n"), F.col("cutoff"), as_of).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query()
def r_m07_all_labels(spark: SparkSession, d: str) -> DataFrame:
    """All default labels; r_m07_labels asks for question marks only. A null content is 'direct'."""
    return _records(spark, d).select("id", collections.labels(F.coalesce("content", F.lit(""))).alias("label"))


@query()
def r_x13_all_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """All default reasons in all languages; r_x13_exclusion has three of them in English."""
    return _records(spark, d).filter(F.col("content").isNotNull()).select("id", events.exclusion(F.col("content")).alias("reason"))


# The older path and streams' batch twins ------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, coalesce(s, 0.5) AS s, (value % 200) / 100 - 1 AS v, (event_id % 10) / 10.0::double AS a, (event_id % 60)::double AS days, event_id % 4 = 0 AS saga, event_id % 2 = 0 AS done FROM events LEFT JOIN (SELECT vec_id, round(list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)), 6) AS s FROM embeddings) ON vec_id = event_id)
SELECT event_id, round(0.35::double * s + 0.25::double * greatest(0::double, 1 - abs(v)) + 0.2::double * pow(0.5::double, days / CASE WHEN greatest(0::double, (v + 1) / 2) * a >= 0.5 THEN 30.0::double ELSE 7.0::double END) + 0.2::double * CASE WHEN saga THEN 1.5::double ELSE 1.0::double END + CASE WHEN done THEN 0.0::double ELSE 0.3::double END, 8) AS weight FROM e""")
def r_l01_j16_weighted_recall(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    sims = v.crossJoin(F.broadcast(v.filter("vec_id = 0").select(F.col("embedding").alias("q")))).select(F.col("vec_id").alias("event_id"), F.round(scoring.cosine(F.col("embedding"), F.col("q")), 6).alias("s"))
    e = table(spark, d, "events").join(sims, "event_id", "left")
    i = F.col("event_id")
    return e.select("event_id", scoring.recall_weight(F.col("s"), (F.col("value") % 200) / 100 - 1, (i % 10) / 10.0, (i % 60).cast("double"), i % 4 == 0, i % 2 == 0, digits=8).alias("weight"))


@query("SELECT user_id, arg_max(event_id, (w, ts, event_id)) AS picked FROM (SELECT *, round(0.6 * (event_id % 2) + 0.3 * 0.25 * ((event_id % 10) / 10.0) + 0.1 * (1 - least((event_id % 15) / 10, 1.0)), 6) AS w FROM events) GROUP BY 1")
def r_l02_w12_active_pick(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    w = F.round(scoring.active_weight(i % 2, F.lit(0.5), (i % 10) / 10.0, i % 15), 6)
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(w, F.col("ts"), i)).alias("picked"))


@query("SELECT agent_id, session, count(*) AS n FROM (SELECT agent_id, sum(opens) OVER (PARTITION BY agent_id ORDER BY logged_at, id ROWS UNBOUNDED PRECEDING)::bigint AS session FROM (SELECT agent_id, logged_at, id, CASE WHEN epoch_us(logged_at) - lag(epoch_us(logged_at)) OVER (PARTITION BY agent_id ORDER BY logged_at, id) < 2700000000 THEN 0 ELSE 1 END AS opens FROM interaction_log)) GROUP BY 1, 2")
def r_st02_sessions(spark: SparkSession, d: str) -> DataFrame:
    return scoring.sessions(table(spark, d, "interaction_log").select("id", "agent_id", "logged_at"), "agent_id", "logged_at", "id").groupBy("agent_id", "session").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') ")
def r_st01_st04_append_new_only(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return claims.orphans(e.select("event_id"), "event_id", e.filter("event_type = 'view'"), "event_id")


@query("SELECT source_kind FROM (SELECT DISTINCT source_kind FROM records_v1)")
def r_s18_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("source_kind").distinct()


# More operators ---------------------------------------------------------------------------------------------------------


@query("""SELECT id, CASE WHEN regexp_matches(content, '(?i)(^|[^\\p{L}])(story|novel)([^\\p{L}]|$)') THEN 'creative' WHEN regexp_matches(content, '(?i)(^|[^\\p{L}])(never|not)([^\\p{L}]|$)') THEN 'negated' WHEN regexp_matches(content, '(?i)(^|[^\\p{L}])(will|tomorrow)([^\\p{L}]|$)') THEN 'future' END AS reason FROM records_v1 WHERE content IS NOT NULL""")
def r_x13_exclusion(spark: SparkSession, d: str) -> DataFrame:
    rules = {name: rf"(?i)(^|[^\p{{L}}])({words})([^\p{{L}}]|$)" for name, words in (("creative", "story|novel"), ("negated", "never|not"), ("future", "will|tomorrow"))}
    return _records(spark, d).filter(F.col("content").isNotNull()).select("id", events.exclusion(F.col("content"), rules).alias("reason"))


@query("SELECT id, concat_ws(',', CASE WHEN contains(lower(content), 'together') THEN 'together' END, CASE WHEN contains(lower(content), 'both') THEN 'both' END, CASE WHEN contains(lower(content), '一起') THEN '一起' END) AS markers FROM records_v1 WHERE content IS NOT NULL")
def r_x14_participation(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter(F.col("content").isNotNull()).select("id", events.participation(F.col("content"), ("together", "both", "一起")).alias("markers"))


@query("SELECT id, coalesce(CASE WHEN lower(trim(role)) = 'user' THEN contains(content, 'my ') WHEN lower(trim(role)) = 'assistant' THEN contains(content, 'your ') END, false) AS directed FROM records_v1")
def r_x15_directional(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", events.directed(F.col("role"), F.col("content"), "my ", "your ").alias("directed"))


@query(f"""WITH {_M}, j AS (SELECT m.record_rowid, m.branch_id, m.position, coalesce(contains({_LC}, 'oven'), false) AS held FROM m JOIN records_v1 r ON r.id = m.record_rowid)
SELECT record_rowid, branch_id, position, max(held::int) OVER (PARTITION BY branch_id ORDER BY position RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM j""")
def r_x16_nearby(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "records_v1_branch_memberships").filter(F.col("position").isNotNull()).distinct()
    rows = m.join(_records(spark, d).select(F.col("id").alias("record_rowid"), "content"), "record_rowid")
    return events.nearby(rows, tx.like_contains(F.col("content"), "oven")).select("record_rowid", "branch_id", "position", "near")


@query("SELECT doc_kind, node, doc_id FROM (SELECT doc_kind, doc_id, row_number() OVER (PARTITION BY doc_kind ORDER BY captured_at NULLS LAST, doc_id) AS node, row_number() OVER (PARTITION BY doc_kind ORDER BY captured_at DESC NULLS FIRST, doc_id DESC) AS back FROM documents) WHERE node <= 6 OR back <= 6")
def r_m06_w05_timeline(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", "captured_at", F.lit("").alias("text"))
    return events.timeline(docs, "doc_id", "doc_kind", "captured_at", "text").select("doc_kind", F.col("node").cast("bigint").alias("node"), "doc_id")


@query()
def r_m06_w05_text_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Timeline nodes by the texts' own clocks, corrections always kept; r_m06_w05_timeline reads no texts. Documents have no
    conflict groups."""
    keep = F.coalesce(F.col("text").rlike(collections.LABELS["correction"]), F.lit(False))
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", "captured_at", "text")
    return events.timeline(docs, "doc_id", "doc_kind", "captured_at", "text", keep=keep).select("doc_kind", F.col("node").cast("bigint").alias("node"), "doc_id")


@query()
def r_m06_w05_record_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The same over records of each conversation, where members of a conflict group are kept too."""
    known = table(spark, d, "source_profiles").groupBy("source_kind").agg(F.min("zone_name").alias("_zone"), F.min("date_order").alias("_order"))
    at = F.timestamp_micros(timestamps.utc_micros(F.col("created_at"), F.col("_zone"), F.col("_order")))
    keep = F.col("conflict_group_id").isNotNull() | F.coalesce(F.col("content").rlike(collections.LABELS["correction"]), F.lit(False))
    rows = _records(spark, d).join(known, "source_kind", "left").withColumn("at", at)
    return events.timeline(rows, "id", "conversation_id", "at", "content", keep=keep).select("conversation_id", F.col("node").cast("bigint").alias("node"), "id")


@query("""WITH b AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'chat' ELSE 'agent' END AS ch, lower(trim(role)) AS r, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c, epoch_us(imported_at) AS t FROM records_v1 WHERE content IS NOT NULL),
e AS (SELECT * FROM b WHERE ch IS NOT NULL AND length(c) >= 32 AND len(list_distinct(string_split(regexp_replace(lower(c), '[^\\p{L}\\p{N}]', '', 'g'), ''))) >= 12),
g AS (SELECT r, c, t, count(DISTINCT id) AS n, count(DISTINCT ch) AS k FROM e GROUP BY 1, 2, 3)
SELECT id AS key FROM e JOIN g USING (r, c, t) WHERE k = 2 AND n >= 2""")
def r_g06_mirror_groups(spark: SparkSession, d: str) -> DataFrame:
    """Import times lie days apart or are equal, so that a cluster is one content of one time."""
    rows = _records(spark, d).withColumn("ch", F.when(F.col("id") % 2 == 0, "chat").otherwise("agent"))
    return collections.mirror_groups(rows, "id", "ch", "role", "content", "imported_at").select("key")


@query("SELECT user_id, count(DISTINCT concat('agt-', event_id % 7)) AS n_grants FROM events WHERE event_type = 'click' GROUP BY 1")
def r_g15_effective_grants(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).filter("event_kind = 'grant'")
    return g.groupBy(F.col("record").alias("user_id")).agg(F.size(F.collect_set("target_agent")).cast("bigint").alias("n_grants"))


@query("SELECT agent_id, least(0.95, 0.6 + CASE WHEN count(*) FILTER (WHERE contains(lower(user_msg), 'ledger')) >= 2 THEN 0.2 ELSE 0 END)::double AS confidence FROM interaction_log GROUP BY 1")
def r_g16_mention_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.contains(F.lower("user_msg"), F.lit("ledger")))
    return table(spark, d, "interaction_log").groupBy("agent_id").agg(F.least(F.lit(0.95), F.lit(0.6) + F.when(n >= 2, 0.2).otherwise(0.0)).alias("confidence"))


@query("SELECT source_kind, count(*) AS n, count(*) FILTER (WHERE verified) AS n_verified, count(*) FILTER (WHERE content IS NULL) AS n_null FROM records_v1 GROUP BY 1")
def r_g20_s10_preflight_counters(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("source_kind").agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"), F.count_if(F.col("content").isNull()).alias("n_null"))


@query("""WITH o AS (SELECT snapshot_id, segment_index, content_hash, row_number() OVER (PARTITION BY snapshot_id, segment_index ORDER BY message_index, content_hash) AS p FROM guijian_message WHERE content_hash IS NOT NULL),
e AS (SELECT a.snapshot_id, a.content_hash AS l, b.content_hash AS r, count(*) AS support FROM o a JOIN o b ON a.snapshot_id = b.snapshot_id AND a.segment_index = b.segment_index AND b.p = a.p + 1 WHERE a.content_hash <> b.content_hash GROUP BY 1, 2, 3)
SELECT e.snapshot_id, e.l AS "left", e.r AS "right", e.support FROM e LEFT JOIN e x ON x.snapshot_id = e.snapshot_id AND x.l = e.r AND x.r = e.l WHERE x.support IS NULL OR e.support * 2 >= x.support * 3""")
def r_g19_capture_edges(spark: SparkSession, d: str) -> DataFrame:
    return captures.edges(table(spark, d, "guijian_message"), "snapshot_id", "segment_index", "message_index", "content_hash")


@query()
def r_s08_u08_unique_order(spark: SparkSession, d: str) -> DataFrame:
    return captures.unique_order(r_g19_capture_edges(spark, d), "snapshot_id")


@query()
def r_s08_w07_message_times(spark: SparkSession, d: str) -> DataFrame:
    return captures.message_times(table(spark, d, "guijian_message"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'purchase'")
def r_w01_latest_per_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("WITH v AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS version, event_id FROM events), k AS (SELECT * FROM v WHERE event_id % 5 <> 0) SELECT user_id, event_type, version FROM (SELECT *, coalesce(lag(version) OVER (PARTITION BY user_id, event_type ORDER BY version), 0) AS b FROM k) WHERE version <> b + 1")
def r_j09_e12_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    kept = claims.versions(e, ["user_id", "event_type"], ["event_id"]).filter(F.col("event_id") % 5 != 0)
    return claims.chain_breaks(kept, ["user_id", "event_type"]).select("user_id", "event_type", F.col("version").cast("bigint").alias("version"))


@query("""WITH c AS (SELECT l_orderkey AS conflict_id, l_partkey AS claim_id FROM lineitem), r AS (SELECT p_partkey AS claim_id FROM part WHERE p_partkey % 10 <> 3), m AS (SELECT DISTINCT * FROM c WHERE conflict_id IN (SELECT conflict_id FROM c GROUP BY 1 HAVING count(DISTINCT claim_id) >= 2) AND conflict_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0))
SELECT conflict_id, count(*) AS n_members, bool_and(claim_id IN (SELECT claim_id FROM r)) AS readable FROM m GROUP BY 1""")
def r_k04_k06_conflicts(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conflict_id"), F.col("l_partkey").alias("claim_id"))
    decided = table(spark, d, "orders").filter(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("conflict_id"))
    readable = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") % 10 != 3).alias("readable"))
    return claims.mask_conflicts(claims.register_conflicts(members, decided), readable)


@query("""WITH v AS (SELECT user_id AS claim_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS active FROM events), e AS (SELECT id, id % 150 AS claim_id FROM records_v1) SELECT e.id, e.claim_id, v.version FROM e JOIN v ON v.claim_id = e.claim_id AND active""")
def r_j05_m15_annotations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("claim_id"), "event_id")
    v = claims.versions(e, ["claim_id"], ["event_id"])
    r = _records(spark, d).select("id")
    return claims.annotate(r, "id", r.withColumn("claim_id", F.col("id") % 150), v).withColumn("version", F.col("version").cast("bigint"))


@query("""WITH c AS (SELECT conversation_id AS case_id, list_distinct(list(record_id) FILTER (WHERE verified AND id % 2 = 0)) AS must, list_distinct(list(record_id) FILTER (WHERE id % 31 = 0)) AS mustnot FROM records_v1 GROUP BY 1), g AS (SELECT conversation_id AS case_id, list_distinct(list(record_id)) AS got FROM records_v1 WHERE id % 3 <> 0 OR verified GROUP BY 1),
j AS (SELECT c.case_id, coalesce(must, []) AS a, coalesce(mustnot, []) AS n, coalesce(got, []) AS got FROM c LEFT JOIN g USING (case_id))
SELECT case_id, CASE WHEN len(a) + len(n) = 0 THEN 'unscored' WHEN len(list_filter(a, lambda x: NOT list_contains(got, x))) = 0 AND len(list_filter(n, lambda x: list_contains(got, x))) = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM j""")
def r_m22_u07_replay(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    cases = r.groupBy(F.col("conversation_id").alias("case_id")).agg(F.collect_set(F.when(F.col("verified") & (F.col("id") % 2 == 0), F.col("record_id"))).alias("must_all"), F.collect_set(F.when(F.col("id") % 31 == 0, F.col("record_id"))).alias("must_not")).withColumn("must_any", F.array().cast("array<string>"))
    got = r.filter((F.col("id") % 3 != 0) | F.col("verified")).select(F.col("conversation_id").alias("case_id"), "record_id")
    return regression.replay(cases, got).select("case_id", "outcome")


@query("SELECT family, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contains(text, 'bad') THEN 'bad' END, CASE WHEN contains(text, 'late') THEN 'late' END, CASE WHEN contains(text, 'lost') THEN 'lost' END], lambda x: x IS NOT NULL)) AS family FROM documents) GROUP BY 1")
def r_g11_n32_issue_families(spark: SparkSession, d: str) -> DataFrame:
    return regression.families(table(spark, d, "documents"), "text", {"bad": "bad", "late": "late", "lost": "lost"})


@query("SELECT id, translate(content, '我你', '你我') AS swapped FROM records_v1 WHERE contains(content, '我') OR contains(content, '你')")
def r_n13_pronoun_swap(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _records(spark, d).filter(F.contains(c, F.lit("我")) | F.contains(c, F.lit("你"))).select("id", F.translate(c, "我你", "你我").alias("swapped"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2023-12-31 16:00:00' AND ts < TIMESTAMP '2024-01-31 16:00:00'")
def r_n19_calendar_scope(spark: SparkSession, d: str) -> DataFrame:
    """'last month' asked in February 2024, as local days at UTC+8."""
    from datetime import datetime, timezone

    from recallspark.plans.planner import calendar_scope

    scope = calendar_scope("what happened last month", datetime(2024, 2, 10, tzinfo=timezone.utc))
    low, high = (F.lit(x.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") for x in (scope.start, scope.end))
    return table(spark, d, "events").filter((F.col("ts") >= low) & (F.col("ts") < high)).select("event_id")


@query("SELECT snapshot_id, role, count(*) AS n FROM (SELECT snapshot_id, CASE json_extract_string(i, '$.type') WHEN 'userMessage' THEN 'user' ELSE 'assistant' END AS role FROM (SELECT snapshot_id, unnest(json_extract(t, '$.items[*]')) AS i FROM (SELECT snapshot_id, unnest(json_extract(h, '$.turns[*]')) AS t FROM (SELECT snapshot_id, unnest(json_extract(threads, '$[*]')) AS h FROM codex_rollout_v1 WHERE json_valid(threads)))) WHERE json_extract_string(i, '$.type') IN ('userMessage','agentMessage')) GROUP BY 1, 2")
def r_s07_rollout_messages(spark: SparkSession, d: str) -> DataFrame:
    return packages.rollout_messages(table(spark, d, "codex_rollout_v1")).groupBy("snapshot_id", "role").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE m AS (SELECT backup_id, m.conversationId AS cid, m.sourceMessageId AS mid, m.parentSourceMessageId AS parent FROM (SELECT backup_id, unnest(data.messages) AS m FROM room_ferry_backup_v1)),
r AS (SELECT m.*, 0 AS depth FROM m LEFT JOIN m p ON p.backup_id = m.backup_id AND p.cid = m.cid AND p.mid = m.parent WHERE p.mid IS NULL UNION ALL SELECT m.*, r.depth + 1 FROM m JOIN r ON r.backup_id = m.backup_id AND r.cid = m.cid AND r.mid = m.parent),
u AS (SELECT r.* FROM r JOIN (SELECT DISTINCT backup_id, c.id AS cid, c.currentLeafSourceMessageId AS leaf FROM (SELECT backup_id, unnest(data.conversations) AS c FROM room_ferry_backup_v1)) l ON l.backup_id = r.backup_id AND l.cid = r.cid AND l.leaf = r.mid UNION ALL SELECT r.* FROM r JOIN u ON u.backup_id = r.backup_id AND u.cid = r.cid AND u.parent = r.mid)
SELECT DISTINCT backup_id, cid, mid, depth AS position FROM u""")
def r_s05_w06_tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return packages.tree_backup_messages(table(spark, d, "room_ferry_backup_v1")).filter(F.col("position").isNotNull()).select("backup_id", "cid", "mid", "position").distinct()


@query("""SELECT id, name, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '"([^"]{2,16})"', 1)) AS name FROM records_v1) GROUP BY 1, 2""")
def r_m11_quoted_names(spark: SparkSession, d: str) -> DataFrame:
    found = _records(spark, d).select("id", F.explode(collections.extract_names(F.col("content"), r'"([^"]{2,16})"')).alias("name"))
    return found.groupBy("id", "name").agg(F.count("*").alias("n"))
