import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from recallspark.functions import text as tx
from recallspark.operators import claims, collections, context, lexical, scoring, visibility


def test_bm25_against_sqlite(spark):
    rng = random.Random(3)
    words = ["harbour", "ledger", "tower", "ledgerledger", "été", "Bridge", "lamp"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    base = sqlite3.connect(":memory:")
    try:
        base.execute("create virtual table t using fts5(c, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer here")
    base.executemany("insert into t(rowid, c) values (?, ?)", [(i + 1, c) for i, c in docs])
    want = dict(base.execute("select rowid - 1, bm25(t) from t where t match '\"ledger\" OR \"bridge\"'").fetchall())
    df = spark.createDataFrame(docs, "id int, c string")
    got = {r.id: r.score for r in lexical.bm25(df, "id", "c", ["ledger", "bridge"]).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_case_rules(spark):
    df = spark.createDataFrame([("ÉTÉ Bridge 100% a_b",), (None,), ("",)], "c string")
    c = F.col("c")
    row = df.select(tx.like_contains(c, "éTÉ").alias("a"), tx.like_contains(c, "bRIDGE").alias("b"), tx.phrase_contains(c, "été").alias("p"), tx.phrase_contains(c, "ét").alias("s"), tx.like_contains(c, "0% A_").alias("l"), tx.like_contains(c, "1%a").alias("n")).collect()
    assert row[0].asDict() == {"a": False, "b": True, "p": True, "s": False, "l": True, "n": False}
    assert row[1].a is None and row[2].a is False


EVENTS = [
    (1, "own", "set_owner", "a", None), (2, "shared", "scope_shared", None, None), (3, "given", "grant", "b", None), (4, "taken", "grant", "b", None), (5, "taken", "revoke", None, 4),
    (6, "moved", "grant", "b", None), (7, "moved", "scope_shared", None, None), (8, "moved", "set_owner", "c", None), (9, "closed", "grant", "b", None), (10, "closed", "scope_private", None, None),
]


def test_visibility_truth_table(spark):
    events = spark.createDataFrame(EVENTS, "event_seq long, record string, event_kind string, target_agent string, target_event_seq long")
    agents = spark.createDataFrame([(a,) for a in ("anchor", "a", "b", "c")], "agent string")
    records = spark.createDataFrame([(r, 1) for r in ("own", "shared", "given", "taken", "moved", "closed", "fresh")], "record string, event_seq int")
    got = {(r.record, r.agent): r.channel for r in visibility.channels(records, events, agents).collect()}
    expected = {("own", "a"): "owner", ("given", "anchor"): "owner", ("given", "b"): "grant", ("taken", "anchor"): "owner", ("closed", "anchor"): "owner", ("fresh", "anchor"): "owner", ("moved", "c"): "owner"}
    expected |= {("shared", x): "scope_shared" for x in "abc"} | {("shared", "anchor"): "owner"} | {("moved", x): "scope_shared" for x in ("anchor", "a", "b")}
    assert got == expected
    for agent in ("anchor", "a", "b", "c"):
        seen = {r.record for r in visibility.visible(records, "record", events, agent).collect()}
        assert seen == {r for r, x in expected if x == agent}


def test_state_machines(spark):
    a = spark.createDataFrame([(1, "x", "disabled"), (2, "x", "registered"), (3, "x", "disabled"), (4, "x", "registered"), (5, "y", "registered"), (6, "y", "disabled"), (7, "y", "re-enabled"), (8, "z", "re-enabled")], "event_seq long, agent string, event_kind string")
    assert {r.agent: r.state for r in visibility.agent_state(a).collect()} == {"x": "disabled", "y": "active", "z": "disabled"}
    c = spark.createDataFrame([(1, "x", "issued"), (2, "x", "revoked"), (3, "x", "issued"), (4, "y", "issued"), (5, "y", "rotated")], "event_seq long, credential string, event_kind string")
    assert {r.credential: r.state for r in visibility.credential_state(c).collect()} == {"x": "revoked", "y": "rotated"}
    d = spark.createDataFrame([("p", 1, "resolved"), ("p", 2, "unresolved"), ("q", 1, "stale")], "conflict_id string, seq long, decision string")
    all_ = spark.createDataFrame([("p",), ("q",), ("r",)], "conflict_id string")
    assert {r.conflict_id: r.status for r in claims.conflict_status(all_, d).collect()} == {"p": "open", "q": "stale", "r": "open"}


def test_mirrors_are_anchored(spark):
    text = "The harbour desk sorted 12 wet ledgers before dawn, twice."
    stamps = [("a1", "chat", 0.0), ("b1", "agent", 0.4), ("a2", "chat", 0.9), ("b2", "agent", 1.3), ("a3", "chat", 2.2), ("c", "chat", 9.0)]
    rows = [(k, ch, "user", text, s) for k, ch, s in stamps] + [("short", "chat", "user", "too short", 0.0), ("nul", "chat", "user", None, 0.0)]
    df = spark.createDataFrame(rows, "key string, ch string, role string, t string, s double").withColumn("at", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
    got = collections.mirror_groups(df, "key", "ch", "role", "t", "at").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, set()).add(r.key)
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "b1"], ["a3", "b2"]]


def test_windows_and_bundles(spark):
    m = spark.createDataFrame([(i, "b", p) for i, p in enumerate([0, 1, 2, 5, 63, 64, 65, None])] + [(0, "b", 0)], "record_rowid long, branch_id string, position int")
    hits = m.filter("record_rowid in (2, 5, 7)")
    got = {(r.hit, r.near) for r in context.window_join(hits, m, 1, 2).collect()}
    assert got == {(2, 1), (5, 4), (5, 6)}
    rows = [(1, 0, "assistant", "commentary"), (2, 2, "assistant", "final_answer"), (3, 3, "assistant", "commentary"), (4, 4, "user", None), (5, 5, "assistant", "final_answer"), (6, 63, "assistant", "commentary"), (7, 66, "assistant", "final_answer"), (8, 67, "assistant", "commentary")]
    df = spark.createDataFrame([(i, "c", "b", p, r, ph) for i, p, r, ph in rows], "id long, conversation_id string, branch_id string, position int, role string, phase string")
    assert {(r.id, r.final_id, r.distance) for r in context.nearest_final(df).collect()} == {(1, 2, 2), (6, 7, 3)}


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.s for r in df.select(scoring.cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, None, None]


def test_claims(spark):
    s = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("j", 1, None)], "claim string, seq int, v string")
    v = claims.versions(claims.changed_only(s, ["claim"], ["seq"], "v"), ["claim"], ["seq"])
    assert sorted((r.claim, r.seq, r.version, r.status) for r in v.collect()) == [("j", 1, 1, "active"), ("k", 1, 1, "superseded"), ("k", 3, 2, "active")]
    assert claims.chain_breaks(v, ["claim"]).count() == 0
    assert claims.chain_breaks(v.filter("not (claim = 'k' and version = 1)"), ["claim"]).count() == 1


def test_nearest_in_blocks(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(90)] + [(90, [0.0] * 4), (91, None)]
    df = spark.createDataFrame(rows, "vec long, e array<float>")
    got = {}
    for r in scoring.nearest(df, "vec", "e", df.filter("vec % 20 = 0"), "vec", "e", 5, block=17).collect():
        got.setdefault(r.query, []).append((r.rank, r.key, r.similarity))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    good = [(i, e) for i, e in rows if e and any(e)]
    for i, e in good:
        if i % 20 == 0:
            want = sorted(((-cos(e, f), j) for j, f in good))[:5]
            assert [(k, j) for k, j, _ in sorted(got[i])] == [(n + 1, j) for n, (_, j) in enumerate(want)]


def test_event_windows_with_many_rows_at_one_position(spark):
    """By plain Python; positions below 0 and positions that hold many rows, where hits and rows mustn't be paired."""
    rng = random.Random(9)
    rows = sorted({(i, rng.choice(["a", "b", None]), rng.choice([None, -3, -1, 0, 0, 0, 5, 63, 64, 70]), rng.random() < 0.4, rng.random() < 0.3) for i in range(400)}, key=lambda r: r[0])
    want = set()
    for hit, branch, at, anchor, _ in rows:
        near = [(p, i, anchor_ and said) for i, b, p, anchor_, said in rows if branch is not None and b == branch and at is not None and p is not None and at - 6 <= p <= at + 4]
        if anchor and any(x[2] for x in near):
            want.add((branch, hit, at, len(near), sum(x[2] for x in near), min(x[:2] for x in near if x[2])[1]))
    df = spark.createDataFrame(rows, "record_rowid long, branch_id string, position int, anchored boolean, said boolean")
    got = context.event_windows(df, F.col("anchored"), F.col("said"), F.lit(False))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    hot = spark.range(60_000).select(F.col("id").alias("record_rowid"), F.lit("a").alias("branch_id"), F.lit(0).alias("position"))
    many = context.event_windows(hot, F.lit(True), F.col("record_rowid") == 7, F.lit(False))
    assert [tuple(r) for r in many.groupBy("n_rows", "n_event_rows", "first_event").count().collect()] == [(60_000, 1, 7, 60_000)]
