import hashlib
import json
import zipfile

from recallspark.sources import exports, packages


def test_numbers_and_dump():
    cases = {0.0: "0", -0.0: "0", 1.0: "1", 1.5: "1.5", 1e21: "1e+21", 1.25e-7: "1.25e-7", 0.000001: "0.000001", 123456789012345680000.0: "123456789012345680000", -2.5e30: "-2.5e+30", 100.0: "100"}
    assert {k: exports.number_text(k) for k in cases} == cases
    assert exports.dump({"b": [1, 2.0, None, True], "a": "é\"\n"}) == '{"b":[1,2,null,true],"a":"é\\"\\n"}'


def test_backup_files(spark, tmp_path):
    data = {"messages": [{"id": "m", "n": 1.0}]}
    good = {"checksumAlgorithm": "SHA-256", "checksum": hashlib.sha256(b'{"messages":[{"id":"m","n":1}]}').hexdigest(), "data": data}
    for name, value in (("a", good), ("b", good | {"checksum": "0" * 64}), ("c", good | {"checksumAlgorithm": "MD5"}), ("d", {"no": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "e.json").write_text("{broken")
    got = {r.file[-6]: r.state for r in exports.backup_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "valid", "b": "mismatch", "c": "unsupported", "d": "damaged", "e": "damaged"}


def test_zip_messages(spark, tmp_path):
    def node(parent, role, content, at=1.5):
        return {"parent": parent, "message": None if role is None else {"id": "m-" + str(at), "author": {"role": role}, "create_time": at, "content": content}}

    text = lambda *parts: {"content_type": "text", "parts": list(parts)}
    mapping = {
        "root": node(None, None, None), "a": node("root", "user", text("hi", {"content_type": "image"}, ""), 1.0), "t": node("a", "assistant", {"content_type": "thoughts", "thoughts": [{"summary": "s", "content": "c", "chunks": ["c", "d"]}, {"summary": " ", "content": "", "chunks": []}]}, 2.0),
        "r": node("t", "assistant", {"content_type": "reasoning_recap", "content": "took a while"}, 3.0), "b": node("r", "assistant", text("hello"), 4.0), "x": node("a", "assistant", text("other"), 5.0), "s": node("b", "system", text("hidden"), 6.0), "e": node("b", "user", text("  "), 7.0),
    }
    both = [{"conversation_id": "c1", "current_node": "e", "mapping": mapping}, {"id": "c2", "current_node": "gone", "mapping": {"a": mapping["a"]}}]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("conversations.json", json.dumps(both))
    got = {(r.conversation_id, r.node): (r.role, r.content, r.phase, r.position) for r in exports.zip_messages(packages.zip_shards(spark, str(tmp_path))).collect()}
    assert got == {
        ("c1", "a"): ("user", "hi\n[image]", None, 0), ("c1", "t"): ("assistant", "s\nc\nd", "thoughts", 1), ("c1", "r"): ("assistant", "took a while", "reasoning_recap", 2),
        ("c1", "b"): ("assistant", "hello", None, 3), ("c1", "x"): ("assistant", "other", None, None), ("c2", "a"): ("user", "hi\n[image]", None, None),
    }
    broken = spark.createDataFrame([("a", "s", "{damaged"), ("a", "t", None)], "archive string, shard string, conversations string")
    assert exports.zip_messages(broken).count() == 0


def test_dominant_segment_and_cards(spark, tmp_path):
    from recallspark.operators import collections, regression
    from recallspark.sources import captures

    runs = {("a", 0): "abcd", ("a", 1): "bd", ("b", 0): "ab", ("b", 1): "ba", ("c", 0): "xy", ("c", 1): "xy", ("d", 0): "p"}
    rows = [(c, s, i, h) for (c, s), run in runs.items() for i, h in enumerate(run)] + [("e", 0, 0, None)]
    df = spark.createDataFrame(rows, "cap string, seg int, p int, h string")
    assert {(r.cap, r.segment) for r in captures.dominant_segment(df, "cap", "seg", "p", "h").collect()} == {("a", 0), ("b", -1), ("c", 0), ("d", 0)}
    assert ("e", "no_hash") in {tuple(r) for r in captures.attested(df, "cap", "p", "h").collect()}
    cards = spark.createDataFrame([("1", "open", ["x", "x"], None), ("1", "open", ["x", "x"], None), ("2", None, [], ["l"])], "case_id string, status string, families array<string>, layers array<string>")
    path = str(tmp_path / "cards")
    assert regression.write_cards(cards, path) == 2 and regression.write_cards(cards, path) == 0 and regression.write_cards(regression.review(cards, "1", "fixed"), path) == 1
    assert {tuple(r) for r in regression.report(cards).collect()} == {("status", "open", 3), ("family", "x", 2), ("layer", "l", 1)}
    log = spark.createDataFrame([(1, None), (2, None)], "id int, at timestamp")
    assert {r.day for r in collections.occurrence_groups(log, "id", "at").collect()} == {"record:1", "record:2"}
