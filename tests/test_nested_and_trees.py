import json
import random

from pyspark.sql import functions as F

from recallspark.operators import dewey, hierarchy


def test_rollout_edges(spark):
    good = json.dumps([{"turns": [{"status": None, "id": "t1", "items": [{"id": "i1", "type": "userMessage", "content": [{"type": "text", "text": "x"}, {"type": "localImage"}]}, {"id": "i2", "aggregatedOutput": ""}, {"id": "i3", "type": "reasoning", "content": ["a", "b"]}, {"id": "i4", "aggregatedOutput": None}]}], "id": "h1"}, {"id": "h2", "turns": None}, {"id": "h3"}])
    rows = [(1, good, "clash"), (2, good[:-9], "x"), (3, None, "x"), (4, "", "x"), (5, "[]", "x")]
    df = spark.createDataFrame(rows, "snapshot_id long, threads string, label string")
    t = dewey.rollout_tables(df)
    flat = {level: sorted((r.parent_id, r.id, r.type, r.label, r.parent_label) for r in rows.collect()) for level, rows in t.items()}
    assert flat["turn"] == [("h1", "t1", "", "0.0", "0")]
    assert [x[:3] for x in flat["item"]] == [("t1", "i1", "userMessage"), ("t1", "i2", ""), ("t1", "i3", "reasoning"), ("t1", "i4", "")]
    assert flat["part"] == [("i1", "0", "text", "0.0.0.0", "0.0.0"), ("i1", "1", "localImage", "0.0.0.1", "0.0.0")]
    assert [x[:2] for x in flat["output"]] == [("i2", "0")]


def test_shred_joins_back(spark):
    df = spark.createDataFrame([(1, ([("a", [(1,), (2,)]), ("b", None), None],)), (2, None)], "k long, data struct<xs:array<struct<name:string,ys:array<struct<v:int>>>>>")
    tables = dewey.shred(df, "k", "data")
    assert set(tables) == {"xs", "xs.ys"}
    parent, child = tables["xs"], tables["xs.ys"]
    joined = child.alias("c").join(parent.alias("p"), (F.col("c.k") == F.col("p.k")) & (F.col("c.parent_label") == F.col("p.label")))
    assert sorted((r.name, r.v) for r in joined.select("name", "v").collect()) == [("a", 1), ("a", 2)]


def brute(rows):
    parent = {}
    for t, n, p in rows:
        if n is not None:
            old = parent.get((t, n), "none")
            parent[(t, n)] = p if old in ("none", None) else (old if p is None else min(old, p))
    out = {}
    for t, n in parent:
        at, seen, depth = n, set(), 0
        while True:
            if at in seen:
                out[(t, n)] = ("", -1)
                break
            seen.add(at)
            up = parent[(t, at)]
            if up is None or (t, up) not in parent:
                out[(t, n)] = (at, depth)
                break
            at, depth = up, depth + 1
    return out


def test_forest_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("chain", f"n{i}", f"n{i - 1}" if i else None) for i in range(150)]
    rows += [("ring", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("ring", "tail", "r2"), ("ring", "tail2", "tail"), ("ring", "free", None), ("self", "s", "s")]
    for t in range(12):
        rows += [(f"t{t}", f"x{i}", rng.choice([None, "", "absent"] + [f"x{j}" for j in range(20)])) for i in range(20)]
    rows += rows[:10] + [(None, "a", None), (None, "b", "a"), ("x", None, "a")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "tree_col string, node_col string, parent_col string, node string, n int")
    placed = hierarchy.forest(df, "tree_col", "node_col", "parent_col").cache()
    got = {(r.tree, r.node): (r.root, r.depth) for r in placed.collect()}
    assert got == brute(rows)
    # Descendants and intervals agree with the ancestor pairs.
    pairs = hierarchy.ancestor_pairs(placed)
    counted = {(r.tree, r.ancestor): r.n for r in pairs.groupBy("tree", "ancestor").agg(F.count("*").alias("n")).collect()}
    for r in placed.filter("depth >= 0").collect():
        assert r.descendants == counted.get((r.tree, r.node), 0)
    inside = placed.alias("a").join(placed.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.root") == F.col("b.root")) & (F.col("b.entry") > F.col("a.entry")) & (F.col("b.entry") < F.col("a.exit")))
    assert inside.count() == pairs.filter(F.col("tree").isNotNull()).count()
    path = {r.node: r.path for r in hierarchy.paths(placed).filter("tree = 'chain'").collect()}
    assert path["n3"] == "n0/n1/n2/n3" and path["n149"].count("/") == 149


def test_forest_empty(spark):
    df = spark.createDataFrame([], "t string, a string, b string")
    assert hierarchy.forest(df, "t", "a", "b").count() == 0


def test_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS_PER_TASK", 40)
    rows = [("t", "root", None)] + [("t", f"c{i}", "root") for i in range(500)] + [("t", f"g{i}", f"c{i % 7}") for i in range(60)]
    placed = hierarchy.forest(spark.createDataFrame(rows, "t string, a string, b string"), "t", "a", "b").cache()
    assert {(r.tree, r.node): (r.root, r.depth) for r in placed.collect()} == brute(rows)
    assert placed.filter("node = 'root'").first().descendants == 560
    assert placed.select("entry").distinct().count() == 561
