from pyspark.sql import functions as F

from recallspark.operators import claims, collections, events, regression
from recallspark.sources import captures


def test_event_rules(spark):
    rows = [("user", "We both walked together"), ("user", "I will never go"), ("assistant", "if you like, a story"), (None, None)]
    df = spark.createDataFrame(rows, "role string, t string")
    t = F.col("t")
    got = [(r.x, r.p, r.d) for r in df.select(events.exclusion(t).alias("x"), events.participation(t).alias("p"), events.directed(F.col("role"), t, "(?i)we", "(?i)you").alias("d")).collect()]
    assert got == [(None, "together,we both", True), ("negated", "", False), ("creative", "", True), (None, "", False)]


def test_nearby_and_clock(spark):
    df = spark.createDataFrame([(i, "b", p, w) for i, (p, w) in enumerate([(0, "x"), (2, "hit"), (3, "x"), (7, "x"), (None, "hit"), (None, "x")])], "record_rowid long, branch_id string, position int, w string")
    near = {r.record_rowid: r.near for r in events.nearby(df, F.col("w") == "hit").collect()}
    assert near == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}
    c = spark.createDataFrame([("met at 2024-05-01T10:00Z there",), ("2024-05-01T10:00Z",), (None,)], "t string").select(events.clock(F.col("t")).alias("m")).collect()
    assert [r.m for r in c] == [1714557600000000, None, None]
    nodes = events.timeline(df.withColumn("at", F.timestamp_seconds(F.col("position"))), "record_rowid", "branch_id", "at", "w", 1, 1)
    assert sorted((r.node, r.record_rowid) for r in nodes.collect()) == [(1, 0), (6, 5)]


def test_replay(spark):
    cases = spark.createDataFrame([("a", ["1", "2"], None, None), ("b", None, ["3"], ["9"]), ("c", None, None, None), ("d", [], ["7"], [])], "case_id string, must_all array<string>, must_any array<string>, must_not array<string>")
    results = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "5"), ("b", "3"), ("b", "9"), ("a", None)], "case_id string, record_id string")
    assert {r.case_id: r.outcome for r in regression.replay(cases, results).collect()} == {"a": "pass", "b": "fail", "c": "unscored", "d": "fail"}
    assert {r.case_id: r.shared for r in regression.overlap(results, results.filter("record_id <> '5'")).collect()} == {"a": 2, "b": 2}


def test_conflicts(spark):
    members = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("z", "1"), ("z", "3")], "conflict_id string, claim_id string")
    decisions = spark.createDataFrame([("z", "resolved", "1")], "conflict_id string, decision string, target string")
    assert {r.conflict_id for r in claims.register_conflicts(members, decisions).collect()} == {"x"}
    again = claims.record_decisions(decisions, decisions.unionByName(spark.createDataFrame([("x", "stale", None)], decisions.schema)))
    assert again.count() == 2
    readable = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "claim_id string, readable boolean")
    assert {r.conflict_id: r.readable for r in claims.mask_conflicts(members, readable).collect()} == {"x": False, "y": True, "z": True}


def test_capture_order(spark):
    runs = {("s", 0): "abc", ("s", 1): "bcd", ("s", 2): "cb", ("t", 0): "ab", ("t", 1): "ac", ("u", 0): "ab", ("u", 1): "ba"}
    rows = [(snap, seg, i, h) for (snap, seg), run in runs.items() for i, h in enumerate(run)]
    df = spark.createDataFrame(rows, "snap string, seg int, i int, h string")
    got: dict = {}
    for r in captures.unique_order(captures.edges(df, "snap", "seg", "i", "h"), "snap").collect():
        got.setdefault(r.snap, {})[r.message] = r.place
    assert got["s"] == {"a": 0, "b": 1, "c": 2, "d": 3} and set(got["t"].values()) == {-1} and "u" not in got


def test_name_mentions(spark):
    df = spark.createDataFrame([('a boat called Tern and "Blue Heron"; names: Ann, Bob and Cid.',), (None,), ("",)], "t string")
    got = [{(m.name, m.kind) for m in r.m} for r in df.select(collections.name_mentions(F.col("t")).alias("m")).collect()]
    assert got == [{("Tern", "direct"), ("Blue Heron", "quoted"), ("Ann", "delimited"), ("Bob", "delimited"), ("Cid", "delimited")}, set(), set()]
    near = df.select(collections.stands_near(F.col("t"), F.lit("Tern"), "boat").alias("a"), collections.stands_near(F.col("t"), F.lit("Tern"), "Cid").alias("b")).collect()
    assert (near[0].a, near[0].b, near[1].a) == (True, False, False)


def test_packets(spark, tmp_path):
    for name, text in (("a", '{"note": "x", "recall": {"recall_debug": {"top_k": ["1"]}}}'), ("b", '{"note":"x","recall":{"recall_debug":{"top_k":["1"]}}}'), ("c", '{"note": "y"'), ("d", '{"note": "z"}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert {r.note for r in regression.read_packets(spark, str(tmp_path)).collect()} == {"x", "z"}
    assert regression.read_packets(spark, str(tmp_path)).count() == 2
