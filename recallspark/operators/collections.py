"""Provenance groups, occurrence days, named items and timeline labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import distinct_alnum


def source_summary(rows: DataFrame, by: Sequence[str], key: str, conversation: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_records"), F.count_distinct(key).alias("n_ids"), F.count_distinct(conversation).alias("n_conversations"))


def mirror_groups(rows: DataFrame, key: str, channel: str, role: str, text: str, at: str, within: float = 1.0, least_chars: int = 32, least_alnum: int = 12) -> DataFrame:
    """(key, group_id): records of equal role and whitespace-collapsed content within `within` seconds of their cluster's first
    one, where exactly two channels meet.

    Clusters are anchored at their first member, not chained. Copies are counted per content and instant first; what is folded
    in order of time are different instants, cut where none lies within `within` of the next, as no cluster crosses such a
    gap. Contents too short or too poor to be told apart are left out; null texts and times too.
    """
    content = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    ready = rows.filter(F.col(text).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(channel).alias("channel"), F.xxhash64(F.lower(F.trim(F.col(role))), content).alias("bucket"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), content.alias("content"))
    ready = ready.filter((F.length("content") >= least_chars) & (distinct_alnum(F.col("content")) >= least_alnum)).drop("content")
    width = int(within * 1_000_000)
    # Clusters only depend on the different instants of a content; its copies of one instant are one point.
    points = ready.groupBy("bucket", "micros").agg(F.count("*").alias("n"))
    order = Window.partitionBy("bucket").orderBy("micros")
    gap = F.coalesce((F.col("micros") - F.lag("micros").over(order) > width).cast("int"), F.lit(0))
    cut = points.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy("bucket", "run").agg(F.array_sort(F.collect_list("micros")).alias("at"))
    zero = F.struct(F.lit(None).cast("bigint").alias("start"), F.array().cast("array<struct<micros:bigint,start:bigint>>").alias("out"))

    def step(acc: Column, micros: Column) -> Column:
        start = F.when(acc["start"].isNull() | (micros - acc["start"] > width), micros).otherwise(acc["start"])
        return F.struct(start.alias("start"), F.concat(acc["out"], F.array(F.struct(micros.alias("micros"), start.alias("start")))).alias("out"))

    starts = runs.select("bucket", F.explode(F.aggregate("at", zero, step, lambda acc: acc["out"])).alias("p")).select("bucket", "p.micros", "p.start")
    members = ready.join(starts, ["bucket", "micros"])
    groups = members.groupBy("bucket", "start").agg(F.min("key").alias("first"), F.count_distinct("key").alias("n"), F.count_distinct("channel").alias("channels"))
    kept = groups.filter((F.col("channels") == 2) & (F.col("n") >= 2))
    named = kept.select("bucket", "start", F.concat(F.lit("mirror-"), F.substring(F.sha2(F.concat_ws("|", F.col("bucket").cast("string"), F.col("start").cast("string"), F.col("first").cast("string")), 256), 1, 16)).alias("group_id"))
    return members.join(named, ["bucket", "start"]).select("group_id", "key").distinct()


def occurrence_days(rows: DataFrame, key: str, at: str, zone: str = "Asia/Shanghai", ids: int = 24) -> DataFrame:
    """(day, n, first_key): one row per local day; rows without a time are days of their own, named by their key."""
    day = F.coalesce(F.date_format(F.from_utc_timestamp(F.col(at).cast("timestamp"), zone), "yyyy-MM-dd"), F.concat(F.lit("record:"), F.col(key).cast("string")))
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def named_items(mentions: DataFrame, name: str, key: str, at: str, confirmed: str, ids: int = 4) -> DataFrame:
    """Per case-folded name: is any mention a confirmation, the time span, the first ids."""
    return mentions.groupBy(F.lower(F.trim(F.col(name))).alias("name")).agg(
        F.coalesce(F.bool_or(F.col(confirmed)), F.lit(False)).alias("confirmed"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.col(key).cast("string"))), 1, ids), ",").alias("ids"),
    )


#: Timeline labels and their markers, in their fixed order. Configuration, several languages; replace for another archive.
LABELS = {
    "retelling": r"(?i)\b(told me|as (i|we) said|wie gesagt|comme dit|como dije)\b|说过",
    "historical_reference": r"(?i)\b(back then|last time|in the past|damals|letztes mal|à l'époque|la dernière fois|en aquel entonces|la última vez)\b|当时|上次|以前",
    "quoted_or_original": r"(?i)\b(in (my|your|his|her|their|these|those) (own |exact )?words|verbatim|wörtlich|im wortlaut|mot pour mot|textuellement|textualmente|palabra por palabra)\b|原话|原文|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』",
    "correction": r"(?i)\b(not true|correction|falsch|faux|corrección)\b|更正|不是",
    "explicit_detail_addition": r"(?i)\b(to add|one more detail|more precisely|also note|ergänzend|genauer gesagt|pour préciser|j'ajoute|para añadir|más precisamente)\b|补充|具体来说",
    "summary": r"(?i)\b(in summary|to sum up|in short|summary|zusammenfassend|zusammenfassung|kurz gesagt|en résumé|pour résumer|en resumen|resumiendo)\b|总结|总之|概括",
    "plan": r"(?i)\b(will|plan to|wird|va à|va a)\b|打算|计划",
    "question": r"\?|？|^(?i)(warum|pourquoi|why|dime por qué|can you)\b|为什么",
    "reminder": r"(?i)\b(remember|remind|denk daran|rappelle|recuerda)\b|请记住",
}


def labels(text: Column, rules: dict[str, str] = LABELS) -> Column:
    """Comma-joined labels in fixed order; 'direct' where none fits."""
    # Without u only ASCII letters lose their case.
    found = F.filter(F.array(*[F.when(text.rlike(rule.replace("(?i)", "(?iu)")), name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, "direct").otherwise(F.array_join(found, ","))


def extract_names(text: Column, pattern: str = r"[\"“「『]([^\"”」』]{2,16})[\"”」』]") -> Column:
    """Names in quotation marks, 2 to 16 characters."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def support_units(hits: DataFrame, groups: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first `limit` support units of ordered hits: mirrored records take one slot, held by their first member.

    hits is a bounded result list. Result: unit, key of its representative, n members.
    """
    unit = F.coalesce(F.col("group_id"), F.concat(F.lit("record:"), F.col(key).cast("string")))
    joined = hits.join(groups.withColumnRenamed("key", key), key, "left").withColumn("unit", unit)
    each = joined.groupBy("unit").agg(F.min(F.struct(*order, key)).alias("first"), F.count("*").alias("members"))
    return each.orderBy("first").limit(limit).select("unit", F.col(f"first.{key}").alias(key), "members")


#: Words before a name, and before a list of names. Configuration for en, de, fr, es and zh.
CALLED = r"(?:called|named|heißt|heisst|s'appelle|se llama|名叫)"
LISTED = r"(?:names|namen|noms|nombres|名单)"


def name_mentions(text: Column, called: str = CALLED, listed: str = LISTED) -> Column:
    """array<struct<name, kind>> of the names in a text: quoted (2 to 16 characters), direct (after a word such as 'called')
    and delimited (in a list after a word such as 'names:'). Null texts have none."""
    tag = lambda names, kind: F.transform(names, lambda n: F.struct(F.trim(n).alias("name"), F.lit(kind).alias("kind")))
    direct = F.regexp_extract_all(text, F.lit(rf"(?i){called}\s+(?-i:(\p{{Lu}}[\p{{L}}-]{{1,15}}))"), F.lit(1))
    inside = F.regexp_extract(text, rf"(?i){listed}[:：]\s*([^.。;\n]{{2,200}})", 1)
    delimited = F.filter(F.split(inside, r"[,，、]|\s(?:and|und|et|y)\s"), lambda n: F.length(F.trim(n)).between(2, 16))
    found = F.concat(tag(extract_names(text), "quoted"), tag(direct, "direct"), tag(delimited, "delimited"))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<struct<name:string,kind:string>>"))


def stands_near(text: Column, name: Column, marker: str, reach: int = 32) -> Column:
    """Whether a marker stands within `reach` characters after or before a name."""
    quoted = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?is)"), quoted, F.lit(f".{{0,{reach}}}(?:{marker})|(?:{marker}).{{0,{reach}}}"), quoted)
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def occurrence_groups(rows: DataFrame, key: str, at: str, zone: str = "Asia/Shanghai", groups: int = 12, ids: int = 24) -> DataFrame:
    """(day, n, ids, place): the first `groups` occurrence days in the order they were first seen, with their first `ids` keys,
    comma-joined. n counts all rows of a day; rows without a time are days of their own, last."""
    day = F.coalesce(F.date_format(F.from_utc_timestamp(F.col(at).cast("timestamp"), zone), "yyyy-MM-dd"), F.concat(F.lit("record:"), F.col(key).cast("string")))
    each = rows.select(day.alias("day"), F.col(at).alias("at"), F.col(key).alias("k"))
    order = [F.col("first").asc_nulls_last(), F.col("first_key").asc()]
    days = each.groupBy("day").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min("k").alias("first_key")).orderBy(*order).limit(groups)
    # Only the keys that are told are gathered: a limit per day, then at most ids of them.
    told = each.join(days.select("day"), "day", "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("k"))).filter(F.col("i") <= ids)
    named = told.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda x: x["k"].cast("string")), ",").alias("ids"))
    return days.join(named, "day").withColumn("place", F.row_number().over(Window.orderBy(*order))).select("day", "n", "ids", "place")


def provenance_packet(rows: DataFrame, by: Sequence[str], key: str, conversation: str, groups: DataFrame) -> DataFrame:
    """source_summary with n_mirrored, the rows of each source that are in a mirror group (key, group_id)."""
    marked = rows.join(groups.select(F.col("key").alias(key)).distinct().withColumn("_mirror", F.lit(1)), key, "left")
    return marked.groupBy(*by).agg(F.count("*").alias("n_records"), F.count_distinct(key).alias("n_ids"), F.count_distinct(conversation).alias("n_conversations"), F.count("_mirror").alias("n_mirrored"))
