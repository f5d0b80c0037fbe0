import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallspark.engine import Engine
from recallspark.operators import claims, events, identity, lexical, packets, scoring, visibility
from recallspark.plans import intents as I
from recallspark.plans.planner import Scope
from recallspark.session import small
from recallspark.sources import ledger, packages
from recallspark.streaming import views


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _ledger(spark):
    records = spark.createDataFrame([("r1",), ("r2",)], "record_id string")
    agents = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "disabled")], "agent string, state string")
    return identity.Ledger(spark.createDataFrame([], identity.EVENT), records, agents)


def test_writers_validate_and_append(spark):
    book = _ledger(spark).set_owner("r1", "a").grant("r1", "b")
    assert _rows(visibility.live_grants(book.events)) == [("r1", "b")]
    for broken in (lambda: book.grant("r9", "b"), lambda: book.grant("r1", "c"), lambda: book.grant("r1", "b"), lambda: book.grant("r1", "a"), lambda: book.revoke("r1", 1), lambda: book.set_owner("r1", "nobody")):
        with pytest.raises(ValueError):
            broken()
    gone = book.revoke("r1", 2)
    assert visibility.live_grants(gone.events).count() == 0
    with pytest.raises(ValueError):
        gone.revoke("r1", 2)
    again = book.set_owner("r1", "a")  # the same owner again opens a new epoch
    assert visibility.live_grants(again.events).count() == 0
    with pytest.raises(ValueError):
        again.revoke("r1", 2)
    assert [r.event_kind for r in identity.history(gone.set_scope("r1", True).events, "r1").collect()] == ["set_owner", "grant", "revoke", "scope_shared"]
    report = {r.agent: (r.owned, r.granted) for r in identity.agent_report(book.agents, book.events).collect()}
    assert report == {"a": (1, 0), "b": (0, 1), "c": (0, 0)}


def test_fold_equals_aggregate(spark):
    kinds = ["set_owner", "scope_shared", "scope_private", "grant", "revoke"]
    rows = [(i + 1, f"r{i % 7}", kinds[(i * i) % 5], f"a{i % 3}" if (i * i) % 5 in (0, 3) else None, None) for i in range(90)]
    events_ = spark.createDataFrame(rows, identity.EVENT)
    assert _rows(identity.fold_state(events_)) == _rows(visibility.record_state(events_))
    assert identity.fold_state(events_.limit(0)).count() == 0


def test_principals_and_clamps(spark):
    import hashlib

    creds = spark.createDataFrame([("k1", "a", hashlib.sha256(b"t1").hexdigest()), ("k2", "b", hashlib.sha256(b"t2").hexdigest())], "credential string, agent string, token_hash string")
    states = spark.createDataFrame([("k1", "active"), ("k2", "revoked")], "credential string, state string")
    agents = _ledger(spark).agents
    assert identity.resolve_principal("t1", creds, states, agents) == "a"
    for token in ("t2", "t3", "", None):
        with pytest.raises(PermissionError):
            identity.resolve_principal(token, creds, states, agents)
    with pytest.raises(LookupError):
        identity.resolve_principal("t1", creds.limit(0), states, agents)
    updates = spark.createDataFrame([("x", 1, 0.9, 0.2), ("x", 2, 7.0, None), ("y", 1, -1.0, 0.3)], "k string, seq int, warmth double, wit double")
    assert _rows(identity.clamp_updates(updates, "k", "seq", {"warmth": 0.5, "wit": 0.4})) == [("x", 1.0, 0.4), ("y", 0.0, 0.3)]


def test_projection_runs(spark):
    said = spark.createDataFrame([("c", 1, "x"), ("c", 2, "x"), ("c", 3, "y"), ("d", 1, None), ("d", 2, None), (None, 3, "z")], "claim string, at int, said string")
    empty = spark.createDataFrame([], "claim string, said string, version bigint")
    first = claims.next_versions(empty, said, "claim", "at", "said")
    assert _rows(first) == [("c", "x", 1, 1), ("c", "y", 3, 2), ("d", None, 1, 1)]
    assert claims.next_versions(first, said.filter("at = 3"), "claim", "at", "said").count() == 0  # the same again adds nothing
    more = claims.next_versions(first, spark.createDataFrame([("c", 4, "y"), ("c", 5, "x")], said.schema), "claim", "at", "said")
    assert _rows(more) == [("c", "x", 5, 3)]
    stated = spark.createDataFrame([("c", 1, "active"), ("c", 2, "superseded"), ("d", 1, "active"), ("d", 1, "active")], "claim string, version int, status string")
    assert _rows(claims.integrity(stated, "claim")) == [("c", 1, "not_superseded"), ("c", 2, "not_active"), ("d", 1, "repeated")]
    decisions = spark.createDataFrame([(1, "c"), (2, None), (3, "zz")], "decision int, target string")
    versioned = stated.filter("claim = 'c'").withColumnRenamed("claim", "claim_id")
    assert _rows(claims.decision_targets(decisions, versioned)) == [(1, "c", 2, "superseded"), (2, None, None, None), (3, "zz", None, None)]


def test_ledger_and_import(spark, tmp_path):
    store = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "h1", "x"), ("b", "h2", "y"), ("b", "h2", "y")], "record_id string, content_sha256 string, content string")
    book, seen = ledger.Ledger(spark, store), []
    assert book.take_in("one", "f", rows, lambda state, n: seen.append((state, n)))["added"] == 2
    assert seen == [("registered", 3), ("done", 2)]
    assert book.take_in("one", "f", rows.orderBy(F.desc("record_id")))["status"] == "replay"
    with pytest.raises(ledger.BatchConflict):
        book.take_in("one", "f", rows.limit(1))
    clash = spark.createDataFrame([("a", "other", "z"), ("n", "h3", "n")], rows.schema)
    with pytest.raises(ValueError):
        book.take_in("two", "f", clash)
    assert {r.state for r in book.batches().collect()} == {"done", "failed"}
    assert book.register("two", "f", clash)[1] == "resume" and spark.read.parquet(store + "/records").count() == 2
    assert ledger.batch_id("a", "b") == ledger.batch_id("a", "b") != ledger.batch_id("ab", "")
    good = {"record_id": "r", "source_kind": "k", "source_ref": "x", "conversation_id": "c", "branch_id": "b", "message_id": "m", "role": "user", "content": "hi", "created_at": "2024-01-02T03:04:05Z", "source_cutoff_at": "2024-01-02T03:04:05Z", "verified": True, "authority": "o"}
    path = str(tmp_path / "h.jsonl")
    open(path, "w").write(json.dumps(good) + "\n" + json.dumps(good | {"record_id": "q", "role": "boss"}) + "\n")
    done = ledger.import_history(spark, path, store + "2")
    assert done["added"] == 1 and done["failed"] == 1 and ledger.import_history(spark, path, store + "2")["status"] == "replay"
    read = packages.read_jsonl(spark, path).drop("_corrupt")
    assert ledger.dry_run(read)["n_good"] == 1 and ledger.inspect(read)["n_records"] == 2
    assert ledger.write(read, str(tmp_path / "out")) == 1
    m = lambda rows: spark.createDataFrame(rows, "record_id string, branch_id string, position int")
    assert _rows(packages.membership_conflicts(m([("r", "b", 1), ("r", "c", None), (None, "b", 2)]), m([("r", "b", 0), ("r", "c", 4), (None, "b", 1)]))) == [("r", "b", 1, 0)]


def test_packets_on_nulls_and_empties(spark):
    at = datetime(2024, 1, 1)
    rows = [("1", at, "the lantern was counted"), ("2", at, "when did we move the lantern?"), ("3", None, "lantern finished"), ("4", at + timedelta(days=1), "lantern finished, never mind"), ("5", at, None), ("6", at, "plan to buy a lantern"), ("7", at, "advised a lantern"), ("8", at, "")]
    df = spark.createDataFrame(rows, "id string, at timestamp, text string")
    labels = {r.id: r.l for r in df.select("id", packets.occurrence_labels(F.col("text")).alias("l")).collect()}
    assert labels["5"] == labels["8"] == labels["4"] == ["topic_mention"] and labels["2"] == ["question_or_prompt"]
    packet = packets.event_collection(df, "id", "at", "text", ["Lantern"]).first()
    assert (packet.event_count_lower_bound, packet.occurrence_ids, packet.plan_ids, packet.attribution_ids, packet.status) == (2, "1,3", "6", "7", "bounded_evidence_collected")
    assert packets.event_collection(df.limit(0), "id", "at", "text", ["x"]).first().status == "no_evidence"
    assert packets.label_partitions(df.limit(0), "id", "text").count() == 0
    names = [(" Ann ", 1, at, True, False, True, False), ("ann", 2, None, False, False, False, False), ("Bo", 3, at, True, False, False, False), ("Cy", 4, at, None, True, None, None), ("Di", 5, at, True, True, True, True), ("  ", 6, at, True, True, True, False), (None, 7, at, True, True, True, False)]
    mentions = spark.createDataFrame(names, "name string, k int, at timestamp, ok boolean, cand boolean, rel boolean, out boolean")
    items = packets.named_collection(mentions, "name", "k", "at", "ok", "cand", "rel", "out")
    assert {r.name: (r.status, r.n) for r in items.collect()} == {"ann": ("confirmed", 2), "bo": ("unresolved", 1), "cy": ("candidate", 1)}
    assert packets.inventory(items).count() == 3
    a, b = (spark.createDataFrame(x, "k string, o int") for x in ([("x", 2), ("x", 1), (None, 5)], [("x", 0), ("y", 3), (None, 1)]))
    assert _rows(packets.ordered_union([a, b], "k", "o")) == [("x", 1, 0), ("y", 3, 1), (None, 5, 0)]
    hits = spark.createDataFrame([("a", [("b",), ("a",)]), ("c", None), ("d", [])], "k string, e array<struct<k:string>>")
    assert _rows(packets.expand_evidence(hits, "k", "e")) == [("a", True), ("b", False), ("c", True), ("d", True)]
    passes = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c"), (2, 1, "a"), (2, 2, "a")], "pass_no int, rank int, k string")
    assert [(r.k, r.pass_no) for r in packets.merge_passes(passes, "k", 5).orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 1)]
    cut = packets.bounded(spark.createDataFrame([("x" * 9,), (None,), ("ab",)], "t string"), ["t"], 4).collect()
    assert [(r.t, r.t_chars, r.t_truncated) for r in cut] == [("xxxx…", 9, True), (None, None, False), ("ab", 2, False)]
    kept = packets.redacted(spark.createDataFrame([(1, "s", "f" * 64)], "id int, content string, content_sha256 string"), "content_sha256")
    assert kept.columns == ["id", "fingerprint"] and kept.first().fingerprint == "f" * 12
    kinds = spark.createDataFrame([("k",), (None,)], "kind string")
    assert _rows(packets.kinds_in_scope(kinds, "kind", ["k", "z"])) == [("k", "in_scope"), ("z", "absent"), (None, "unexpected")]
    candidates, selected = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", 1)], "k string, position int")
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "k string, group_id string")
    assert _rows(packets.exclusions(candidates, selected, groups, "k")) == [("b", "exact_mirror", "a", 1), ("c", "result_limit", None, None)]
    assert packets.subject_only(df, "text", None).count() == 0 and small(df).count() == small(df, 2).count() == 8
    told = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("02.01.2023",), ("no",), (None,)], "w string")
    assert packets.first_mention(told, "w", F.lit("UTC")).first().n_without == 2


def test_traces(spark):
    docs = [(1, 3, '- "the lamp burned till the morning"\nshort\nHeading that ends with:'), (2, 1, "he said the lamp burned till the morning and left"), (3, 2, "nothing here"), (4, 4, None)]
    df = spark.createDataFrame(docs, "id int, at int, text string")
    found = lexical.trace_anchors(df.filter("id = 1"), "text")
    assert found[0] == "the lamp burned till the morning" and all(len(a) >= 8 for a in found) and not any(a.endswith(":") for a in found)
    assert lexical.trace_anchors(df.limit(0), "text") == []
    assert [r.id for r in lexical.original_trace(df, "id", "text", "at", found).orderBy("rank").collect()] == [2, 1]
    assert lexical.original_trace(df, "id", "text", "at", []).count() == 0
    said = ["the lantern was not lit", "we will leave. There hung a lantern over the door of the old house", "如果有灯笼", None, ""]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    assert [r.r for r in texts.select("i", events.exclusion_near(F.col("t"), "lantern|灯笼").alias("r")).orderBy("i").collect()] == ["negated", None, "hypothetical", None, None]
    clocks = ["met at 2024-01-02 03:04Z", "于2024-01-02T03:04:05+08:00", "not at 2024-01-02 03:04Z", "2024-01-02 03:04Z", "at 2024-13-45 03:04Z", None]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(clocks)], "i int, t string").select("i", events.clock(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [1704164640000000, 1704135845000000, None, None, None, None]
    row = spark.createDataFrame([I.question_row("q", "zzz")], lexical.QUESTION)
    assert lexical.full_cascade(df.select("id", "text"), "id", "text", row).count() == 0


def test_intents():
    cases = {
        "what does lantern mean": ("meaning", ("lantern",)), "how to make the manual": ("procedure", ("manual",)), "when was the first gift": ("earliest_gift", ()), "when did you first say I love you": ("first_love", ()),
        "how did Biscuit come to us": ("arrival", ("Biscuit",)), "did you say your favourite perfume": ("attributed_preference", ("perfume",)), 'where is "glass bridge" now': ("anchors", ("glass bridge",)),
        "my favourite tea": ("preference", ("tea",)), "the latest barbecue and takeaway": ("latest_composite", ("barbecue", "takeaway")), "我们第一次去海边": ("first_together", ("我们",)), "the first lantern walk": ("oldest", ()), "hello": ("plain", ()), "": ("plain", ()),
    }
    for question, (kind, required) in cases.items():
        found = I.intent(question)
        assert (found.kind, found.required) == (kind, required), question
    assert {k for k, _ in cases.values()} == {*I.INTENTS, "plain"}
    assert I.enumeration("玻璃屋、悬崖、blue key", ["悬崖"]) == ["玻璃屋", "blue key"] and I.enumeration("no list") == []
    assert I.scene("聊到了银色的羽毛，后来你用羽毛把我缠住了")[0] == ["银色", "羽毛"] and I.scene("plain") == ([], [], [])
    assert I.topic_grams("第一次我给你的礼物盒子") [0] == "我给你的" and "你给我的" in I.topic_grams("我给你的礼物盒子")
    assert I.event_intent("我们一共几次烧烤").subject == "烧烤" and I.event_intent("hello") is None
    assert I.name_intent("list all boats").subject == "boats" and len(I.collection_passes(I.name_intent("list all boats"))) == 3
    assert I.meal_subject("我们没吃过榴莲吗") == "榴莲" and I.meal_subject("没吃过东西吗") is None and I.origin_subject("why is Biscuit called that") == "Biscuit"
    assert I.anchors_first('where is "x y"', ["x y"]) and not I.anchors_first('"x y"', ["x y"]) and not I.anchors_first("x", [])
    assert I.event_terms("我们第一次一起去灯塔")["anchor_terms"] or I.event_terms("我们第一次一起去灯塔")["anchor_phrases"]
    assert I.coverage_guard("what was on 2030-01-02", date(2024, 1, 1))["coverage_gap"] and not I.coverage_guard("2020-01-01", None)["coverage_gap"]
    assert I.suppress_timeline({"nodes": [1], "status": "ok"}, True)["nodes"] == [] and I.suppress_timeline({"nodes": [1]}, False) == {"nodes": [1]}
    assert I.retelling_query("the harbour walk", None) is None
    start = datetime(2024, 1, 1)
    scope = Scope(start, start + timedelta(days=1), "day")
    assert "harbour" in I.retelling_query("harbour walk yesterday", scope) and I.scope_packet(scope, [{}] * 5)["outside_retellings"] == [{}] * 3 and not I.scope_packet(None)["applied"]
    assert I.rescue_trace("q", ["a", "b"], {"b": 2, "a": 1})["kept"] == "b" and I.rescue_trace("q", ["a"], {})["kept"] == "q"
    assert (I.inner_limit(3), I.inner_limit(50), I.inner_limit(5, "named"), I.oversample(40, True), I.oversample(40, False)) == (8, 20, 32, 100, 40)
    assert I.passes("how many times did we meet Ann") [0][0] == "initial" and len(I.passes("几次烧烤", scope, ["x"])) == 4


def test_stateful_streams(spark, tmp_path):
    rows = [(1, "a", 0, 15), (2, "a", 10, 15), (3, "a", 15, 15), (4, "b", 3, 60), (5, "a", 29, 15), (6, "a", 31, 15)]
    df = spark.createDataFrame(rows, "id int, agent string, m int, gap int").withColumn("at", F.timestamp_seconds(F.col("m") * 60))
    path = str(tmp_path / "p")
    for low in (1, 4):
        df.filter(F.col("id").between(low, low + 2)).coalesce(1).write.mode("append").parquet(path)
    stream = views.read_events(spark, path, "id int, agent string, m int, gap int, at timestamp", 1)
    q = views.pushes(stream, "agent", "at", "gap").writeStream.format("memory").queryName("pushes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.agent, r["at"].minute) for r in spark.sql("select * from pushes").collect()) == [("a", 0), ("a", 15), ("a", 31), ("b", 3)]
    kinds = ["set_owner", "scope_shared", "scope_private", "grant"]
    events_ = spark.createDataFrame([(i + 1, f"r{i % 3}", kinds[(i * 7) % 4], f"a{i % 2}" if (i * 7) % 4 in (0, 3) else None, None) for i in range(30)], identity.EVENT)
    path = str(tmp_path / "e")
    for part in (1, 0):  # the later half comes first
        events_.filter((F.col("event_seq") > 15) == bool(part)).coalesce(1).write.mode("append").parquet(path)
    q = views.record_states(views.read_events(spark, path, identity.EVENT, 1)).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.record: (r.owner, r.shared, r.epoch) for r in spark.sql("select * from states").collect()}
    assert last == {r.record: (r.owner, r.shared, r.epoch) for r in visibility.record_state(events_).collect()}


def test_scores(spark):
    df = spark.createDataFrame([(1, "烦, 蠢 谢谢", "a", 0.9), (2, None, "a", -0.9), (3, "难过 哭 催", "a", 0.8), (4, "", "a", 0.1), (5, "", None, None)], "id int, t string, g string, v double")
    got = {r.id: (r.i, r.x) for r in df.select("id", scoring.importance(F.col("t")).alias("i"), scoring.toxicity(F.col("t")).alias("x")).collect()}
    assert got == {1: (0.5, 0.3), 2: (0.5, 0.0), 3: (1.0, 0.0), 4: (0.5, 0.0), 5: (0.5, 0.0)}
    assert [(r.id, r.other) for r in scoring.opposite_pairs(df, "g", "id", "v").orderBy("id").collect()] == [(2, 1), (3, 2)]
    assert scoring.active_rank(df.limit(0), "g", "id", "v", 3).count() == 0


def test_engine_asks(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, f"r{i}", "c", ("user", "assistant")[i % 2], f"note {i} about the glass bridge was counted" if i % 3 == 0 else f"note {i}", start + timedelta(days=i), True, "official", "agent-log", "x") for i in range(12)]
    records = spark.createDataFrame(rows, "id long, record_id string, conversation_id string, role string, content string, created_at timestamp, verified boolean, authority string, source_kind string, source_ref string").withColumn("source_cutoff_at", F.col("created_at"))
    members = spark.createDataFrame([(i, "b", i) for i in range(12)], "record_rowid long, branch_id string, position int")
    engine = Engine(records, members)
    asked = engine.ask('where is "glass bridge"').orderBy("rank").collect()
    assert [r.id for r in asked] == [0, 3, 6, 9] and asked[0].tier_name == "anchored_intent"
    assert engine.ask('"no such thing" here').count() == 0
    top, lost = engine.debug('"glass bridge"', spark.createDataFrame([("r0", "g"), ("r9", "g")], "record_id string, group_id string"), limit=2)
    assert top.count() == 2 and {(r.record_id, r.reason) for r in lost.collect()} == {("r6", "result_limit"), ("r9", "exact_mirror")}
    assert engine.event_collection("how many times did we glass bridge").first().event_count_lower_bound == 4 and engine.event_collection("hello") is None
    assert engine.guard("what was on 2031-01-01")["coverage_gap"]
    path = str(tmp_path / "index")
    assert engine.rebuild_index(path) > 0 and tuple(engine.check_index(path).first()) == (0, 0)
    assert engine.trace('"glass bridge"').count() >= 0
    with pytest.raises(ValueError):
        engine.identity(records)


def test_numbering_in_parts(spark):
    from recallspark.plans.skew import numbered

    rows = [("hot", 997 * i % 1000) for i in range(1000)] + [(None, 3), (None, 1), ("c", 5)]
    df = spark.createDataFrame(rows, "g string, o int")
    one, parts = (_rows(numbered(df, ["g"], ["o"], "n", floor)) for floor in (5000, 10))
    assert one == parts and len(one) == 1003
    assert numbered(df.limit(0), ["g"], ["o"], "n").count() == 0
    versions = claims.versions(df, ["g"], ["o"])
    assert {(r.g, r.o) for r in versions.filter("status = 'active'").collect()} == {("hot", 999), (None, 3), ("c", 5)}


def test_first_and_last_rows(spark):
    from recallspark.operators import context

    rows = [("a", i, i == 9) for i in range(20)] + [(None, i, True) for i in range(3)] + [("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, k boolean")
    ends = _rows(context.first_last(df, ["g"], ["o"], 2, 2).select("g", "o"))
    assert ends == sorted([("a", 0), ("a", 1), ("a", 18), ("a", 19), ("b", 1), (None, 0), (None, 1), (None, 2)], key=str)
    assert ("a", 9) in _rows(context.first_last(df, ["g"], ["o"], 2, 2, F.col("k")).select("g", "o")) and context.first_last(df, ["g"], ["o"], 2, 2, F.col("k")).count() == 9
