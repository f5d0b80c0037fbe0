"""Rules on event rows: why a mention doesn't count, who did what to whom, food nearby, timeline nodes with their clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators import timestamps
from recallspark.operators.context import window_join

#: Reasons of exclusion in order, first match wins. Configuration for en, de, fr, es and zh.
EXCLUSIONS = {
    "creative": r"(?i)\b(story|novel|poem|roman|gedicht|cuento)\b|小说|故事里",
    "negated": r"(?i)\b(never|not|didn't|nicht|nie|jamais|nunca)\b|没有|从未|不曾",
    "future": r"(?i)\b(will|tomorrow|wird|morgen|demain|mañana)\b|明天|将要",
    "hypothetical": r"(?i)\b(if|would|falls|wenn|si|ojalá)\b|如果|假如",
    "invitation": r"(?i)\b(let's|shall we|wollen wir|on y va|vamos)\b|一起去吧|要不要",
    "companion": r"(?i)\b(keep(ing)? (you|me) company|kept (you|me) company|leiste(te)? (dir|mir) gesellschaft|(te|me) tenir compagnie|(te|me) hago compañía)\b|(陪|陪着|看着)(你|我).{0,4}(吃|喝)",
}
PARTICIPATION = ("together", "we both", "with me", "zusammen", "ensemble", "juntos", "一起", "我们")


def exclusion(text: Column, rules: dict[str, str] = EXCLUSIONS) -> Column:
    """The first reason that fits, or null."""
    # Without u only ASCII letters lose their case.
    return F.coalesce(*[F.when(text.rlike(rule.replace("(?i)", "(?iu)")), name) for name, rule in rules.items()])


def exclusion_near(text: Column, event: str, reach: int = 24, rules: dict[str, str] = EXCLUSIONS) -> Column:
    """The first reason that stands within `reach` characters of the event (a pattern), on either side and in one sentence,
    or null: a denial elsewhere in a long text says nothing of the event."""
    gap = rf"[^.!?。！？]{{0,{reach}}}?"
    return F.coalesce(*[F.when(text.rlike(rf"(?iu)(?:{rule}){gap}(?:{event})|(?:{event}){gap}(?:{rule})"), name) for name, rule in rules.items()])


def participation(text: Column, markers: tuple[str, ...] = PARTICIPATION) -> Column:
    """The markers a text has, comma-joined; '' if none."""
    return F.array_join(F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(m)), m) for m in markers]), lambda x: x.isNotNull()), ",")


def directed(role: Column, text: Column, said_by_user: str, said_by_assistant: str) -> Column:
    """Whether a row states a relation in the wanted direction; pronouns turn round with the speaker."""
    who = F.lower(F.trim(role))
    return F.coalesce(F.when(who == "user", text.rlike(said_by_user)).when(who == "assistant", text.rlike(said_by_assistant)), F.lit(False))


def nearby(rows: DataFrame, condition: Column, reach: int = 2) -> DataFrame:
    """rows (record_rowid, branch_id, position, ...) with near: does the condition hold within `reach` positions on the branch.

    Positions may have gaps. Rows without a position only see themselves. The join is on cells of positions, so that a hot
    branch is spread over tasks.
    """
    held = rows.filter(F.coalesce(condition, F.lit(False))).select("record_rowid", "branch_id", "position")
    seen = window_join(held, rows.select("record_rowid", "branch_id", "position"), reach, reach, own=True)
    seen = seen.select(F.col("near").alias("record_rowid"), "branch_id", F.col("near_position").alias("position"), F.lit(True).alias("_near")).distinct()
    joined = rows.join(seen, ["record_rowid", "branch_id", "position"], "left")
    return joined.withColumn("near", F.coalesce("_near", F.col("position").isNull() & condition, F.lit(False))).drop("_near")


#: Words that bind a time to what is said, and words that deny it. Configuration.
BINDING = r"(?:\b(?:at|on|since|um|am|seit|le|depuis|el|desde)\b|于|在|从)"
DENIED = r"(?:\b(?:not|never|nicht|nie|pas|jamais|no|nunca)\b|不是|没有|并非)"


def clock(text: Column, binding: str = BINDING, reach: int = 24, denied: str = DENIED) -> Column:
    """Microseconds of an absolute zoned time that stands within `reach` characters after a binding word, else null; also
    null where a word within `reach` characters before the binding word denies it."""
    stamp = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})"
    bound = rf"(?i){binding}[^\d]{{0,{reach}}}?({stamp})"
    found = F.when(~text.rlike(rf"(?i){denied}[^\d.!?。！？]{{0,{reach}}}?{binding}[^\d]{{0,{reach}}}?{stamp}"), F.regexp_extract(text, bound, 1))
    return timestamps.utc_micros(F.nullif(found, F.lit("")))


def timeline(rows: DataFrame, key: str, topic: str, at: str, text: str, first: int = 6, last: int = 6, keep: Column | None = None) -> DataFrame:
    """(topic, node, key, occurred, recorded): the timeline's nodes in order, those of unknown time last, then by key.

    The occurrence is the text's own clock, else the record's. All nodes that keep marks stay beside the first and last.
    """
    timed = rows.withColumns({"_recorded": F.unix_micros(F.col(at).cast("timestamp")), "_keep": F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)})
    timed = timed.withColumn("_occurred", F.coalesce(clock(F.col(text)), F.col("_recorded")))
    order = [F.col("_occurred").asc_nulls_last(), F.col(key).asc()]
    back = [F.col("_occurred").desc_nulls_first(), F.col(key).desc()]
    ranked = timed.withColumn("_n", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).withColumn("_m", F.row_number().over(Window.partitionBy(topic).orderBy(*back)))
    kept = ranked.filter((F.col("_n") <= first) | (F.col("_m") <= last) | F.col("_keep"))
    return kept.select(topic, F.col("_n").alias("node"), key, F.col("_occurred").alias("occurred"), F.col("_recorded").alias("recorded"))
