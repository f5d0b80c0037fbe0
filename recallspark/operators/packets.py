"""What a recall hands out: collections of events and names, merged passes, bounded and debug packets.

Inputs named hits or candidates are bounded result lists; everything else works on whole tables by aggregation. Nulls in text
have no markers; null times come last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import truncate
from recallspark.operators import timestamps

#: Markers of what a text says about an event, in their fixed order. Configuration for en, de, fr, es and zh.
QUESTION = ("?", "？", "when did", "wann", "quand", "cuándo", "吗", "为什么")
RETELLING = ("remember", "recall", "erinner", "rappelle", "recuerda", "记得", "记住", "回忆")
PLAN = ("plan to", "will ", "wollen", "demain", "mañana", "打算", "计划", "准备")
COMPLETION = ("finished", "was counted", "were counted", "gezählt", "compté", "contado", "完成", "已经", "搬到")
NOT_COMPLETED = ("not finished", "never", "nicht ", "jamais", "nunca", "没有", "还没")
ATTRIBUTION = ("advised", "recommended", "empfohlen", "conseillé", "recomendado", "建议", "推荐")
#: The names of the labels, in order.
OCCURRENCE_LABELS = ("question_or_prompt", "retelling_or_recollection", "plan_or_candidate", "explicit_occurrence_or_completion", "choice_or_advice_evidence")


def has_any(text: Column, markers: Sequence[str]) -> Column:
    """Whether the small-letter text has one of the markers; false for null."""
    low = F.lower(text)
    return F.coalesce(reduce(or_, [F.contains(low, F.lit(m)) for m in markers], F.lit(False)), F.lit(False))


def occurrence_labels(text: Column) -> Column:
    """array of labels in fixed order; ['topic_mention'] where none fits. A completion that is denied is none."""
    done = has_any(text, COMPLETION) & ~has_any(text, NOT_COMPLETED)
    tests = (has_any(text, QUESTION), has_any(text, RETELLING), has_any(text, PLAN), done, has_any(text, ATTRIBUTION))
    found = F.filter(F.array(*[F.when(test, name) for test, name in zip(tests, OCCURRENCE_LABELS)]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("topic_mention"))).otherwise(found)


def partition_of(labels: Column) -> Column:
    """The partitions of an event collection that a row's labels put it into: occurrence (told as done, and neither asked,
    retold nor planned), retelling, plan, attribution; a row may be in several."""
    has = lambda name: F.array_contains(labels, name)
    question, retold, plan, done, advice = (has(n) for n in OCCURRENCE_LABELS)
    found = F.array(F.when(done & ~question & ~retold & ~plan, F.lit("occurrence")), F.when(retold, F.lit("retelling")), F.when(plan, F.lit("plan")), F.when(advice, F.lit("attribution")))
    return F.filter(found, lambda x: x.isNotNull())


def label_partitions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(partition, n, first_key) over all rows; counted with map-side aggregation, no ids are gathered."""
    each = rows.select(F.col(key).alias("k"), F.explode(partition_of(occurrence_labels(F.col(text)))).alias("partition"))
    return each.groupBy("partition").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


def local_day(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM-dd")


def event_collection(hits: DataFrame, key: str, at: str, text: str, topics: Sequence[str], zone: str = "Asia/Shanghai", evidence: int = 24, groups: int = 12) -> DataFrame:
    """One row: status, event_count_lower_bound, and the ids of each partition, comma-joined in order of time and key.

    Of the hits that name a topic the first `evidence` count. Occurrences of one local day count as one event, those without
    a time each as their own, so that the number is a lower bound; at most `groups` are told.
    """
    seen = hits.filter(has_any(F.col(text), [t.lower() for t in topics])).select(F.col(key).cast("string").alias("k"), F.col(at).alias("at"), occurrence_labels(F.col(text)).alias("labels"))
    seen = seen.orderBy(F.col("at").asc_nulls_last(), "k").limit(evidence).withColumn("partitions", partition_of(F.col("labels")))
    named = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.array_contains("partitions", name), F.struct(F.col("at").isNull().alias("late"), "at", "k")))), lambda x: x["k"]), ",")
    day = F.when(F.array_contains("partitions", "occurrence"), F.coalesce(F.concat(F.lit("day:"), local_day(F.col("at"), zone)), F.concat(F.lit("record:"), F.col("k"))))
    packet = seen.agg(F.count("*").alias("n_evidence"), F.least(F.count_distinct(day), F.lit(groups)).alias("event_count_lower_bound"), *[named(p).alias(f"{p}_ids") for p in ("occurrence", "plan", "attribution", "retelling")])
    return packet.withColumn("status", F.when(F.col("n_evidence") > 0, "bounded_evidence_collected").otherwise("no_evidence"))


def named_collection(mentions: DataFrame, name: str, key: str, at: str, confirmed: str, candidate: str, related: str, outside: str) -> DataFrame:
    """(name, status, first_at, n) of named items, case and outer blanks folded: confirmed (a mention confirms it and one
    supports the asked relation), candidate, or unresolved. Mentions outside the asked relation and blank names don't count.

    The flags are boolean columns; null is false. One aggregation over all mentions.
    """
    flag = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    inside = mentions.filter(~F.coalesce(F.col(outside), F.lit(False))).withColumn("_name", F.lower(F.trim(F.col(name)))).filter(F.length("_name") > 0)
    facts = inside.groupBy(F.col("_name").alias("name")).agg(flag(confirmed).alias("c"), flag(candidate).alias("d"), flag(related).alias("r"), F.min(at).alias("first_at"), F.count_distinct(key).alias("n"))
    return facts.select("name", F.when(F.col("c") & F.col("r"), "confirmed").when(F.col("d"), "candidate").otherwise("unresolved").alias("status"), "first_at", "n")


def inventory(items: DataFrame, most: int = 24) -> DataFrame:
    """The first `most` items of each status with their place: unresolved ones by the number of records (most first), all by
    first mention (unknown first) and name."""
    order = [F.when(F.col("status") == "unresolved", -F.col("n")).otherwise(F.lit(0)), F.col("first_at").asc_nulls_first(), F.col("name")]
    return items.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(*order))).filter(F.col("place") <= most)


def first_mention(rows: DataFrame, written: str, zone: Column | None = None, order: Column | None = None) -> DataFrame:
    """One row: the least instant among written times in any form, and how many have none."""
    micros = timestamps.utc_micros(F.col(written), zone, order)
    return rows.select(micros.alias("m")).agg(F.min("m").alias("first_micros"), F.count_if(F.col("m").isNull()).alias("n_without"))


# Unions and passes ---------------------------------------------------------------------------------------------------------


def ordered_union(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all parts with the columns of the first; a key that is in several, or repeats, comes once: from the first part
    that has it, with the least order there. `part` counts the parts from 0. Null keys are one key."""
    columns = parts[0].columns
    both = reduce(DataFrame.unionByName, [p.select(*columns).withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in columns if c != key]
    first = both.groupBy(key).agg(F.min_by(F.struct("part", *rest), F.struct("part", order)).alias("_first"))
    return first.select(key, "_first.*").select(*columns, "part")


def merge_passes(passes: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, pass_no, rank, place): passes (pass_no, rank, key) merged by one unseen key of each pass in turn.

    A key belongs to the pass that has it at its least rank, the first of equals; what is left of each pass moves up, and the
    merged order is by the new rank and the pass. planner.merge_round_robin, which takes turns strictly, may give a key that
    several passes have to another of them; the sets of keys are the same where limit takes all. Passes are bounded lists."""
    owned = passes.groupBy(key).agg(F.min(F.struct("rank", "pass_no")).alias("o")).select(key, "o.rank", "o.pass_no")
    moved = owned.withColumn("turn", F.row_number().over(Window.partitionBy("pass_no").orderBy("rank", key)))
    first = moved.orderBy("turn", "pass_no").limit(limit)
    return first.select(key, "pass_no", "rank", F.row_number().over(Window.orderBy("turn", "pass_no")).alias("place"))


def expand_evidence(hits: DataFrame, key: str, nested: str) -> DataFrame:
    """(key, primary): the hits and the keys in their nested evidence (array of structs with the same key field), each once;
    a key that is a hit stays one. Null and empty evidence adds nothing."""
    inner = hits.select(F.explode_outer(nested).alias("e")).select(F.col(f"e.{key}").alias(key)).filter(F.col(key).isNotNull())
    both = hits.select(key, F.lit(True).alias("primary")).unionByName(inner.withColumn("primary", F.lit(False)))
    return both.groupBy(key).agg(F.max("primary").alias("primary"))


# Filters -------------------------------------------------------------------------------------------------------------------


def subject_only(rows: DataFrame, text: str, subject: str | None) -> DataFrame:
    """The rows that hold the caller's subject, without case; none where the question names no subject."""
    return rows.filter(F.contains(F.lower(F.col(text)), F.lit(subject.lower()))) if subject else rows.filter(F.lit(False))


def retellings(rows: DataFrame, text: str, at: str, topics: Sequence[str], end: object, later: bool = True) -> DataFrame:
    """Rows that retell one of the topics: after the scope's end if later, else whenever."""
    told = rows.filter(has_any(F.col(text), RETELLING) & has_any(F.col(text), [t.lower() for t in topics]))
    return told.filter(F.col(at) >= F.lit(end)) if later else told


def meaning_mentions(rows: DataFrame, key: str, text: str, markers: Sequence[str], most: int = 6, long: int = 2000) -> DataFrame:
    """(key, score, place): the `most` rows with most markers; texts of more than `long` characters come after all others."""
    score = reduce(lambda a, b: a + b, [F.contains(F.lower(F.col(text)), F.lit(m)).cast("int") for m in markers], F.lit(0))
    scored = rows.select(key, score.alias("score"), (F.length(text) > long).alias("_long")).filter(F.col("score") > 0)
    order = [F.col("_long").asc(), F.col("score").desc(), F.col(key).asc()]
    first = scored.orderBy(*order).limit(most)
    return first.select(key, "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


def mention_confidence(rows: DataFrame, by: str, role: str, text: str, subject: str, base: float = 0.5, more: float = 0.2, least: int = 2) -> DataFrame:
    """(by, mentions, confidence): users' rows that hold the subject; `least` of them or more add `more`."""
    said = rows.filter((F.lower(F.trim(F.col(role))) == "user") & F.contains(F.lower(F.col(text)), F.lit(subject.lower())))
    return said.groupBy(by).agg(F.count("*").alias("mentions")).withColumn("confidence", F.round(F.lit(base) + F.when(F.col("mentions") >= least, more).otherwise(0.0), 2))


def newest(rows: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """The newest rows; unknown times last, ties by the greater key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc()).limit(limit)


def by_first_known(rows: DataFrame, start: str, count: str, key: str, limit: int, most: int = 5) -> DataFrame:
    """Event matches: earliest start, then most participation, then key; at most `most`."""
    return rows.orderBy(F.col(start).asc_nulls_last(), F.col(count).desc(), F.col(key).asc()).limit(min(limit, most))


# Packets -------------------------------------------------------------------------------------------------------------------

#: Fields that no audit output may hold.
FORBIDDEN = ("content", "text", "token", "secret", "content_sha256", "credential_hash")
CHANNELS = {"official-zip": "chat", "tree-backup": "chat", "agent-log": "agent"}


def redacted(rows: DataFrame, hashed: str | None = None, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """rows without the forbidden fields; of the hashed one the first 12 characters stay as fingerprint."""
    out = rows.withColumn("fingerprint", F.substring(F.col(hashed), 1, 12)) if hashed else rows
    return out.drop(*[c for c in rows.columns if c.lower() in forbidden])


def channel(kind: Column, known: dict[str, str] = CHANNELS) -> Column:
    """The channel of a source kind; 'other' for unknown and null ones."""
    out = F.lit("other")
    for source, name in known.items():
        out = F.when(kind == source, name).otherwise(out)
    return out


def bounded(rows: DataFrame, texts: Sequence[str], limit: int = 600) -> DataFrame:
    """rows with each text cut at `limit` characters, and its length and whether it was cut beside it; null stays null."""
    columns = {}
    for c in texts:
        columns |= {f"{c}_chars": F.length(c), f"{c}_truncated": F.coalesce(F.length(c) > limit, F.lit(False)), c: truncate(F.col(c), limit)}
    return rows.withColumns(columns)


def packet(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(packet): each row as one JSON object with the fields in order of name; nulls are written."""
    return rows.select(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("packet"))


def exclusions(candidates: DataFrame, selected: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, reason, merged_into, merged_position) of the candidates that weren't selected (key, position).

    exact_mirror: it shares a mirror group (key, group_id) with a selected row, its representative, of which the first by
    position counts; result_limit otherwise."""
    chosen = groups.join(selected.select(key, "position"), key).groupBy("group_id").agg(F.min(F.struct("position", key)).alias("r")).select("group_id", F.col("r.position").alias("merged_position"), F.col(f"r.{key}").alias("merged_into"))
    lost = candidates.select(key).distinct().join(selected.select(key), key, "left_anti")
    merged = lost.join(groups.join(chosen, "group_id"), key, "left").groupBy(key).agg(F.min(F.struct("merged_position", "merged_into")).alias("m"))
    return merged.select(key, F.when(F.col("m.merged_into").isNotNull(), "exact_mirror").otherwise("result_limit").alias("reason"), "m.merged_into", "m.merged_position")


def kinds_in_scope(records: DataFrame, kind: str, expected: Sequence[str]) -> DataFrame:
    """(kind, status) of all kinds found or expected: in_scope, unexpected or absent. A null kind is unexpected."""
    found = records.select(F.col(kind).alias("kind")).distinct().withColumn("found", F.lit(True))
    wanted = records.sparkSession.createDataFrame([(k,) for k in expected], "kind string").withColumn("wanted", F.lit(True))
    both = found.join(wanted, found["kind"].eqNullSafe(wanted["kind"]), "full").select(F.coalesce(found["kind"], wanted["kind"]).alias("kind"), "found", "wanted")
    return both.select("kind", F.when(F.col("found").isNull(), "absent").when(F.col("wanted").isNull(), "unexpected").otherwise("in_scope").alias("status"))
