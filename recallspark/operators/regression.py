"""The ledger of bad cases: what must and must not be recalled, and the score of a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.session import materialize


def replay(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, outcome, missing, forbidden).

    cases: case_id, must_all, must_any, must_not (arrays of record ids, null or empty where nothing is asked).
    results: case_id, record_id. Outcome: unscored without any demand, else pass or fail; a case without results is scored
    against none.
    """
    found = results.filter(F.col("record_id").isNotNull()).groupBy("case_id").agg(F.collect_set("record_id").alias("_got"))
    empty = F.array().cast("array<string>")
    each = cases.join(found, "case_id", "left").select("case_id", F.coalesce("_got", empty).alias("got"), *[F.coalesce(c, empty).alias(c) for c in ("must_all", "must_any", "must_not")])
    missing, forbidden = F.array_except("must_all", "got"), F.array_intersect("must_not", "got")
    any_ok = (F.size("must_any") == 0) | F.arrays_overlap("must_any", "got")
    asked = F.size("must_all") + F.size("must_any") + F.size("must_not") > 0
    passed = (F.size(missing) == 0) & (F.size(forbidden) == 0) & any_ok
    return each.select("case_id", F.when(~asked, "unscored").when(passed, "pass").otherwise("fail").alias("outcome"), F.size(missing).alias("missing"), F.size(forbidden).alias("forbidden"))


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(case_id, shared): results that two replays have in common."""
    return first.select("case_id", "record_id").intersect(second.select("case_id", "record_id")).groupBy("case_id").agg(F.count("*").alias("shared"))


def families(notes: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Number of notes per issue family; a note may belong to several."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(rule), name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return notes.select(F.explode(hits).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


#: A captured bad case as its file states it.
PACKET = "schema_version string, captured_at string, note string, dialogue array<struct<role:string,content:string>>, recall struct<recall_debug:struct<top_k:array<string>>>"


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """(packet_id, ...) of packet files, one JSON object each; equal packets count once, as the id is made of their content.
    Damaged files give no rows."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", PACKET).alias("p"), "value").filter(F.try_parse_json("value").isNotNull())
    named = whole.select(F.concat(F.lit("case-"), F.substring(F.sha2(F.to_json("p"), 256), 1, 24)).alias("packet_id"), "p.*")
    return named.dropDuplicates(["packet_id"])


#: States a case may be in.
STATUS = ("open", "confirmed", "fixed", "dismissed")


def report(cards: DataFrame) -> DataFrame:
    """(counter, name, n): cards (case_id, status, families, layers) by status, issue family and layer; a card counts once for each
    of its families and layers. Null lists count for nothing."""
    parts = [cards.select(F.lit("status").alias("counter"), F.coalesce("status", F.lit("open")).alias("name"))]
    parts += [cards.select(F.lit(kind).alias("counter"), F.explode(F.array_distinct(column)).alias("name")) for kind, column in (("family", "families"), ("layer", "layers"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("counter", "name").agg(F.count("*").alias("n"))


def write_cards(cards: DataFrame, path: str, kind: str = "cards") -> int:
    """Appends the cards (or replays) that aren't at path yet, as JSON lines named by the hash of their content, and returns how
    many. Equal content is written once; nothing that is there is changed."""
    spark = cards.sparkSession
    body = F.to_json(F.struct(*sorted(cards.columns)), {"ignoreNullFields": "false"})
    named = cards.select(F.sha2(body, 256).alias("content_hash"), body.alias("body")).dropDuplicates(["content_hash"])
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        named = named.join(spark.read.schema("content_hash string, body string").json(str(root)).select("content_hash"), "content_hash", "left_anti")
    # Written once before it is counted and appended, as the anti-join must not see its own output.
    fresh = materialize(named, "cards")
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(str(root))
    return n


def review(cards: DataFrame, case_id: str, status: str) -> DataFrame:
    """cards with another status for one case; an unknown status is an error."""
    if status not in STATUS:
        raise ValueError(f"unknown status: {status}")
    return cards.withColumn("status", F.when(F.col("case_id") == case_id, status).otherwise(F.col("status")))
