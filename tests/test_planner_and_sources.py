import json
import os
import zipfile
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from recallspark.engine import Engine
from recallspark.plans import planner as P
from recallspark.queries import reference
from recallspark.session import table
from recallspark.sources import packages, snapshots
from recallspark.streaming import views

NOW = datetime(2026, 3, 31, 4, tzinfo=timezone.utc)


def utc(y, m, d):
    return datetime(y, m, d, tzinfo=P.LOCAL).astimezone(timezone.utc)


@pytest.mark.parametrize(
    "question,start,end",
    [
        ("what did we do yesterday", utc(2026, 3, 30), utc(2026, 3, 31)),
        ("上个月说了什么", utc(2026, 2, 1), utc(2026, 3, 1)),
        ("最近一个月的进展", utc(2026, 2, 28), utc(2026, 4, 1)),
        ("last week", utc(2026, 3, 23), utc(2026, 3, 30)),
        ("last monday", utc(2026, 3, 23), utc(2026, 3, 24)),
        ("around 2025-12-31", utc(2025, 12, 30), utc(2026, 1, 2)),
        ("三月十五号的事", utc(2026, 3, 15), utc(2026, 3, 16)),
    ],
)
def test_calendar(question, start, end):
    scope = P.calendar_scope(question, NOW)
    assert (scope.start, scope.end) == (start, end)


def test_calendar_without_reference():
    assert P.calendar_scope("yesterday").precision == "unresolved_yesterday"
    assert P.calendar_scope("the harbour") is None
    assert P.month_back(date(2026, 3, 31)) == date(2026, 2, 28)
    assert [P.han_number(x) for x in ("十", "二十一", "三十一", "三十二", "0", "x")] == [10, 21, 31, None, None, None]


def test_plans():
    assert P.plan('who said "the glass bridge" first').anchors == ("the glass bridge",)
    assert P.plan("how do I open the ledger").intent == "procedure"
    assert P.plan("第一次去灯塔是什么时候").intent == "earliest"
    assert P.swap_pronouns("我和你") == "你和我"
    assert P.sample_evenly(list("abcdefg"), 3) == ["a", "d", "g"]
    assert P.subquestions("where is “a; b”; and who has it?") == ["where is “a; b”", "and who has it"]
    long = P.plan("灯塔" * 2000)
    assert len(long.any_terms) <= P.MAX_TERMS and len(P.follow_up_passes("a? b c? d e? f g?")) <= P.MAX_PASSES - 1
    policy = P.RescuePolicy((("lampe", "lamp"),), ("lampe post",))
    assert P.rescue_passes('the lampe by the lampe post, "lampe"', policy) == ['the lamp by the lampe post, "lampe"']
    assert P.merge_round_robin([("initial", ["a", "b", "c"]), ("rescue", ["b", "d"])], 4) == ["b", "a", "d", "c"]


def package(**more):
    return {"schema_version": "records-v1", "record_id": "r1", "source_kind": "k", "source_ref": "s", "conversation_id": "c", "branch_id": "b", "message_id": "m", "role": "user", "content": " Keep  me ", "created_at": "2024-01-01T00:00:00Z", "verified": True, "authority": "official", "source_cutoff_at": "2024-01-02T00:00:00Z"} | more


def test_packages(spark, tmp_path):
    for name, value in (("obj", {"schema_version": "records-v2", "records": [package(), package(record_id="r2")]}), ("arr", [package()]), ("one", package())):
        path = str(tmp_path / f"{name}.json")
        open(path, "w").write("﻿" + json.dumps(value))
        assert packages.read_json(spark, path).count() == (2 if name == "obj" else 1)
    lines = str(tmp_path / "l.jsonl")
    rows = [package(), package(branch_id=None, branch_memberships=[{"branch_id": "z", "position": 3}, {"branch_id": "b", "position": 0}]), package(record_id="bad", role="boss", content=" ", created_at="soon")]
    open(lines, "w").write("\n".join(map(json.dumps, rows)) + "\n{broken")
    read = packages.read_jsonl(spark, lines).cache()
    assert read.filter(F.col("_corrupt").isNotNull()).count() == 1
    checked = packages.errors(read.filter(F.col("_corrupt").isNull()))
    bad = checked.filter("record_id = 'bad'").first().errors
    assert bad == ["content: missing", "role: unknown", "created_at: no instant"]
    records, members = packages.canonical(checked.filter(F.size("errors") == 0))
    assert [r.content for r in records.collect()] == [" Keep  me "]
    assert sorted((r.branch_id, r.position) for r in members.collect()) == [("b", 0), ("z", 3)]
    path = str(tmp_path / "store")
    assert packages.append(records, path, "b1") == 1 and packages.append(records, path, "b1") == 0 and packages.append(records, path, "b2") == 0
    changed = records.withColumn("content_sha256", F.lit("other"))
    assert packages.conflicts(changed, spark.read.parquet(path)).count() == 1
    assert packages.preflight(read.drop("_corrupt")).first().n_records == 4


def test_exports(spark, sf, tmp_path):
    messages = packages.tree_backup_messages(table(spark, sf, "room_ferry_backup_v1"))
    assert messages.count() > 0 and messages.filter("position = 0").count() > 0
    assert packages.rollout_messages(table(spark, sf, "codex_rollout_v1")).filter("role = 'user'").count() > 0
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("export_manifest.json", json.dumps({"logical_files": {"conversations.json": {"files": ["conversations-000.json"]}}}))
        z.writestr("conversations-000.json", "[1]")
        z.writestr("conversations-001.json", "[2]")
    assert [(r.shard, r.conversations) for r in packages.zip_shards(spark, path).collect()] == [("conversations-000.json", "[1]")]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    one, two = spark.range(5).toDF("x"), spark.range(7).toDF("x")
    snapshots.create(one, root, "v1")
    snapshots.create(two, root, "v2")
    snapshots.activate(spark, root, "v1")
    snapshots.activate(spark, root, "v2")
    assert snapshots.read_active(spark, root).count() == 7
    assert snapshots.rollback(spark, root) == "v1" and snapshots.read_active(spark, root).count() == 5
    two.write.mode("append").parquet(f"{root}/v2/data")
    assert not snapshots.verify(spark, root, "v2")
    with pytest.raises(ValueError):
        snapshots.activate(spark, root, "v2")
    assert snapshots.digest(one.repartition(3)) == snapshots.digest(one.orderBy(F.col("x").desc()))


def test_streaming_twins(spark, sf, tmp_path):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    path = str(tmp_path / "events")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    schema = "event_id long, user_id long, ts timestamp_ntz, value double"
    for _ in range(2):  # the second run is a replay
        views.import_batches(views.read_events(spark, path, schema, 1), "event_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == events.count() == spark.read.parquet(str(tmp_path / "out")).count()
    q = views.append_once(views.read_events(spark, path, schema), "event_id", "ts", "3650 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(*) from once").first()[0] == events.count()


def test_engine(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, f"r{i}", "c", ("user", "assistant")[i % 2], f"note {i} about the glass bridge" if i % 3 == 0 else f"note {i}", start + timedelta(days=i), True, "official", "agent-log", "x") for i in range(12)]
    records = spark.createDataFrame(rows, "id long, record_id string, conversation_id string, role string, content string, created_at timestamp, verified boolean, authority string, source_kind string, source_ref string").withColumn("source_cutoff_at", F.col("created_at"))
    members = spark.createDataFrame([(i, "b", i) for i in range(12)], "record_rowid long, branch_id string, position int")
    events = spark.createDataFrame([(1, "r3", "set_owner", "a", None), (2, "r6", "grant", "a", None)], "event_seq long, record string, event_kind string, target_agent string, target_event_seq long")
    open_ = Engine(records, members)
    assert [r.id for r in open_.recall('"glass bridge"').orderBy("rank").collect()] == [0, 3, 6, 9]
    assert open_.recall('"no such thing"').count() == 0
    closed = Engine(records, members, events)
    assert [r.id for r in closed.recall('"glass bridge"', "a", limit=1).collect()] == [3]
    assert {r.near for r in open_.context(open_.recall('"glass bridge"', limit=2)).collect()} == {1, 2, 4, 5}
    assert closed.coverage("a").first().n_records == 2
    evidence = spark.createDataFrame([("r3", "k"), ("r3", "h"), ("r0", "h")], "record_id string, claim_id string")
    versions = spark.createDataFrame([("k", 1, "superseded"), ("k", 2, "active"), ("h", 1, "active")], "claim_id string, version int, status string")
    noted = {r.record_id: r.claims for r in closed.recall_projected('"glass bridge"', evidence, versions, "a").collect()}
    assert [(c.claim_id, c.version) for c in noted["r3"]] == [("k", 2)] and noted["r6"] is None
    assert open_.adaptive_recall('"glass bridge"', limit=3) == ["r0", "r3", "r6"]


def test_queries_run(spark, sf):
    for name, run in reference.queries().items():
        assert run(spark, sf).columns, name
    assert set(reference.oracle_sql()) <= set(reference.queries())
