"""Mixed timestamp texts to one UTC instant, inside Catalyst.

An ordered cascade of anchored patterns rewrites each text to one field list, strict construction of the civil time
rejects impossible dates, and the zone comes from the text or from the caller's column. No Python runs per row and
nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions.binding import let

#: Exactly this form is already normal.
NORMAL_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"

_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_OFFSET = r"([Zz]|UTC|GMT|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?"
_MERIDIEM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_DAY = r"(?:\p{L}{3,9}\.?,\s*)?"


@dataclass(frozen=True)
class Form:
    """pattern is anchored; template lists year|month|day|hour|minute|second|fraction|meridiem|offset|zone."""

    name: str
    pattern: str
    template: str
    order: str | None = None  # needs this date order


#: The cascade, first match wins. Fields missing in a form are empty.
FORMS = (
    Form("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_HMS}\s*{_OFFSET}(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    Form("compact", r"^(\d{4})(\d{2})(\d{2})[Tt\s](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    Form("iso-date", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3|0|0|||||"),
    Form("slash-ymd", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[T,]?\s*{_HMS}{_MERIDIEM}\s*{_OFFSET})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    Form("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s*{_HMS}{_MERIDIEM}\s*{_OFFSET})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    Form("han", r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?:\s*(上午|下午)?\s*(\d{1,2})[:时](\d{2})分?(?::?(\d{2})秒?)?)?$", "$1|$2|$3|$5|$6|$7||$4||"),
    Form("named-month", rf"^{_DAY}(\d{{1,2}})\.?\s+(\p{{L}}{{3,9}})\.?,?\s+(\d{{4}})(?:,?\s+{_HMS}{_MERIDIEM}\s*{_OFFSET})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    Form("month-first", rf"^{_DAY}(\p{{L}}{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_HMS}{_MERIDIEM}\s*{_OFFSET})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    Form("slash-dmy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_HMS}{_MERIDIEM}\s*{_OFFSET})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|", "DMY"),
    Form("slash-mdy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_HMS}{_MERIDIEM}\s*{_OFFSET})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|", "MDY"),
)

#: English month abbreviations in calendar order.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_YEAR_2000, _YEAR_2101 = 946_684_800, 4_133_980_800
#: Overlaps of local time are searched at these shifts, in microseconds.
_SHIFTS = (1_800_000_000, 3_600_000_000, 7_200_000_000)


def _bare_number(text: Column) -> Column:
    """Microseconds of a bare number, in the one unit of s, ms, µs that gives a year from 2000 to 2100."""
    number = F.when(text.rlike(r"^\d{1,17}(\.\d+)?$"), F.regexp_replace(text, r"^(\d+(?:\.\d{1,9})?)\d*$", "$1")).try_cast("decimal(28,9)")
    found = F.lit(None).cast("bigint")
    for factor in (1, 1_000, 1_000_000):
        inside = (number >= F.lit(_YEAR_2000 * factor)) & (number < F.lit(_YEAR_2101 * factor))
        found = F.coalesce(found, F.when(inside, F.floor(number * F.lit(1_000_000 // factor)).cast("bigint")))
    return found


def _month(field: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(field, 1, 3)))
    return F.when(field.rlike(r"^\d+$"), field.try_cast("int")).when(at % 3 == 1, ((at + 2) / 3).cast("int"))


def utc_micros(text: Column, zone: Column | None = None, date_order: Column | None = None, ambiguous: str = "first", nonexistent: str = "before") -> Column:
    """Microseconds since 1970 of a timestamp text, or null where it denotes no instant.

    zone: the zone of zoneless texts; null gives null for them. An unknown zone name gives null.
    date_order: DMY or MDY decides slashed dates; with another order they are read only where one reading is possible.
    ambiguous: 'first', 'last' or 'null' for local times that occur twice.
    nonexistent: 'before' (offset before the change) or 'null' for local times that are skipped.
    Null, empty and blank texts give null. Digits below the microsecond are cut off, missing seconds are 0.
    """
    if ambiguous not in ("first", "last", "null") or nonexistent not in ("before", "null"):
        raise ValueError("unknown policy")
    zone = F.lit(None).cast("string") if zone is None else zone
    date_order = F.lit(None).cast("string") if date_order is None else F.upper(date_order)
    raw = F.regexp_replace(F.translate(text, "０１２３４５６７８９：／－．", "0123456789:/-."), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return let(F.struct(raw.alias("raw"), zone.alias("zone"), date_order.alias("order")), lambda x: _instant(x["raw"], x["zone"], x["order"], ambiguous, nonexistent))


def _instant(raw: Column, zone: Column, date_order: Column, ambiguous: str, nonexistent: str) -> Column:
    first, second = (F.regexp_extract(raw, r"^(\d{1,2})/(\d{1,2})/\d{4}", i).try_cast("int") for i in (1, 2))
    order = F.when(date_order.isin("DMY", "MDY"), date_order).when(first > 12, "DMY").when(second > 12, "MDY")
    fields = F.lit(None).cast("string")
    for form in reversed(FORMS):
        hit = raw.rlike(form.pattern)
        hit = hit & (order == form.order) if form.order else hit
        fields = F.when(hit, F.regexp_replace(raw, form.pattern, form.template)).otherwise(fields)
    dated = let(F.split(fields, r"\|", 10), lambda part: _dated(part, zone, ambiguous, nonexistent))
    return F.when(raw.rlike(r"^\d+(\.\d+)?$"), _bare_number(raw)).otherwise(dated)


def _dated(part: Column, zone: Column, ambiguous: str, nonexistent: str) -> Column:
    get = lambda i: F.nullif(F.get(part, F.lit(i)), F.lit(""))
    hour, meridiem = F.coalesce(get(3), F.lit("0")).try_cast("int"), F.lower(get(7))
    hour = (
        F.when(meridiem.isNull(), hour)
        .when((hour > 12) & meridiem.isin("a", "p"), F.lit(None).cast("int"))
        .when(hour > 12, hour)
        .when(meridiem.isin("p", "下午"), hour % 12 + 12)
        .otherwise(hour % 12)
    )
    second_text = F.concat(F.coalesce(get(5), F.lit("0")), F.lit("."), F.rpad(F.coalesce(F.substring(get(6), 1, 6), F.lit("")), 6, "0"))
    seconds = F.when(F.coalesce(get(5), F.lit("0")).try_cast("int") < 60, second_text.try_cast("decimal(16,6)"))
    civil = F.try_make_timestamp(get(0).try_cast("int"), _month(get(1)), get(2).try_cast("int"), hour, F.coalesce(get(4), F.lit("0")).try_cast("int"), seconds, F.lit("UTC"))
    sign, hours, minutes = (F.regexp_extract(get(8), r"(?i)^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$", i) for i in (1, 2, 3))
    minutes = hours.try_cast("int") * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0))
    fixed = F.when(F.upper(get(8)).isin("Z", "UTC", "GMT"), F.lit(0)).when(minutes <= 18 * 60, F.when(sign == "-", -minutes).otherwise(minutes))
    local_zone = F.coalesce(get(9), zone)
    local_zone = F.when(local_zone.rlike(r"^(UTC|GMT|Z|[A-Za-z]+(/[A-Za-z0-9_+\-]+)+)$"), local_zone)
    return let(
        F.struct(F.unix_micros(civil).alias("wall"), fixed.alias("fixed"), get(8).isNotNull().alias("has_offset"), local_zone.alias("zone")),
        lambda x: F.when(x["has_offset"], x["wall"] - x["fixed"].cast("bigint") * F.lit(60_000_000)).when(x["zone"].isNotNull(), _in_zone(x["wall"], x["zone"], ambiguous, nonexistent)),
    )


def _in_zone(wall: Column, zone: Column, ambiguous: str, nonexistent: str) -> Column:
    """Spark reads a local time that occurs twice as the first, and gives a skipped one the offset before the change."""
    at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))
    if ambiguous == "first" and nonexistent == "before":
        return at
    back = lambda micros: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))

    def by_policy(at: Column) -> Column:
        chosen = at
        for shift in _SHIFTS if ambiguous != "first" else ():
            twice = back(at + F.lit(shift)) == wall
            chosen = F.when(twice, at + F.lit(shift) if ambiguous == "last" else F.lit(None).cast("bigint")).otherwise(chosen)
        return F.when(back(at) == wall, chosen) if nonexistent == "null" else chosen

    return let(at, by_policy)


def needs_normalizing(text: Column) -> Column:
    """True for values that aren't exactly in the normal form."""
    return text.isNotNull() & ~text.rlike(NORMAL_FORM)


def normalize(df: DataFrame, column: str, out: str = "utc_micros", zone: str | None = None, date_order: str | None = None, **policy: str) -> DataFrame:
    """df with the instant of a text column added. All other columns and rows stay."""
    return df.withColumn(out, utc_micros(F.col(column), F.col(zone) if zone else None, F.col(date_order) if date_order else None, **policy))


def found(records: DataFrame, messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows (src, row_id, field, utc_micros) of every value that isn't in the normal form and denotes an instant.

    profiles is a lookup with one row per source kind; it is broadcast only if Spark's size check allows it.
    """
    known = profiles.groupBy("source_kind").agg(F.min("zone_name").alias("_zone"), F.min("date_order").alias("_order"))
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in ("created_at", "source_cutoff_at")])
    left = (
        records.select("id", "source_kind", F.explode(fields).alias("f"))
        .filter(needs_normalizing(F.col("f.text")))
        .join(known, "source_kind", "left")
        .select(F.lit("records_v1").alias("src"), F.col("id").alias("row_id"), F.col("f.field").alias("field"), utc_micros(F.col("f.text"), F.col("_zone"), F.col("_order")).alias("utc_micros"))
    )
    right = messages.filter(needs_normalizing(F.col("created_at"))).select(
        F.lit("guijian_message").alias("src"), F.col("message_key").alias("row_id"), F.lit("created_at").alias("field"), utc_micros(F.col("created_at"), F.col("room_zone")).alias("utc_micros")
    )
    return left.unionByName(right).filter(F.col("utc_micros").isNotNull())
