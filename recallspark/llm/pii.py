"""Personal information in free text by bootstrapped contextual extraction.

One narrow pass finds mentions: strong ones, whose own form names their type (an address with a domain, a number in a
dialling format), and weak ones, which only could be a case. Each has lexical patterns, the words just before and just
after it. Seeds (strong forms, and pairs of lexicon names) give the patterns scores; patterns give their other instances
scores; both are joined as a graph in Spark and scored in turn for some rounds. Patterns of high confidence carry weak
mentions and names that no lexicon has, and the names learned so are known everywhere else. Placeholders then replace
the accepted spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.plans.skew import join_counted
from recallspark.session import materialize

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
ROUNDS = 3
#: Least share of scored instances of a pattern, and least number of its different instances.
CONFIDENCE, SUPPORT = 0.5, 3

_WIDE = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20}

#: Forms of addresses, numbers and titles in the languages read. Groups of digits may be parted by blanks.
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:"
    r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    r"|\s*[\[({<]\s*(?:at|AT|@)\s*[\])}>]\s*[A-Za-z0-9-]+(?:(?:\.|\s*[\[({]?\s*\b(?:dot|DOT)\b\s*[\])}]?\s*)[A-Za-z0-9-]+)*(?:\.|\s*[\[({]?\s*\b(?:dot|DOT)\b\s*[\])}]?\s*)[A-Za-z]{2,}"
    r"|\s+(?:at|AT)\s+[A-Za-z0-9-]+(?:(?:\.|\s+(?:dot|DOT)\s+)[A-Za-z0-9-]+)*\s+(?:dot|DOT)\s+[A-Za-z]{2,})"
)
_S = r"[\s.\-]{1,2}"
_PHONE = re.compile(
    r"(?<![A-Za-z0-9.+])(?:"
    rf"\+\d{{1,3}}{_S}?(?:\(\d{{1,4}}\){_S}?)?\d(?:[\d/]|{_S}(?=\d)){{5,16}}\d"
    rf"|\(\d{{2,4}}\)\s{{0,2}}\d{{3,5}}{_S}\d{{3,4}}"
    rf"|\d{{3}}{_S}\d{{3}}{_S}\d{{4}}"
    rf"|00\d{{2}}{_S}\d{{3}}{_S}\d{{4}}{_S}\d{{4}}"
    r"|0\d{4}\s{1,2}\d{3}\s{0,2}\d{3}"
    rf"|0\d(?:{_S}\d{{2}}){{4}}"
    r"|0\d{2,4}/\d{3,5}[-\s]?\d{2,4}"
    r")(?![A-Za-z0-9])"
)
_IDENTITY = re.compile(
    r"(?<![A-Za-z0-9.+-])(?:"
    r"\d{3}(?:-|\s{1,2})\d{2}(?:-|\s{1,2})\d{4}"
    r"|\d{6}(?:19|20)\d{9}[\dXx]"
    r"|[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]"
    r"|\d{8}-?[A-Za-z]"
    r")(?![A-Za-z0-9])(?!-[A-Za-z0-9])"
)
_STREET_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Close|Boulevard|Blvd|Drive|Way|Court|Ct|Place|Square|Row|Hill|Gardens|Crescent)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.?\s+\d+[A-Za-z]?,?\s+)?"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9])(?:{_UNIT}\d{{1,5}}[A-Za-z]?,?\s+(?:[NSEW]\.?\s+)?(?:[A-Z][\w'’-]+\s+){{1,3}}{_STREET_EN}\b"
    r"|(?i:[\w-]{0,40}(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer)\s+\d{1,4}\s?[a-z]?\b)"
    r"|(?i:\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|impasse|place|allée|chemin|quai|cours|passage)\s+(?:de\s+la\s+|de\s+l['’]|du\s+|des\s+|de\s+|d['’])?[\w'’-]+)"
    r"|(?i:(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carretera|ronda)\s*(?:(?:de\s+la|de\s+los|de\s+las|del|de)\s+)?[\w'’-]+(?:\s+[\w'’-]+)?,?\s+(?:n\.?º\s*)?\d{1,4}\b)"
    rf"|(?P<plain>(?i:{_UNIT}\d{{1,5}}[A-Z]?,?\s+(?:[NSEW]\.?\s+)?[\w'’-]{{3,}}\s+{_STREET_EN}\b))"
    r")|(?:(?![到在址寄住于是])[一-鿿]){2,6}?(?:路|街|巷|大道|胡同|弄)\s*\d+\s*号(?:\s*\d+\s*[栋幢座])?(?:\s*\d+\s*室)?"
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|M|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Señor|Señora)"
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+)*"
_BIG = r"[A-ZÀ-ÖØ-Þ'’]{2,}(?:-[A-ZÀ-ÖØ-Þ'’]{2,})*"
_NAME = re.compile(
    rf"(?=[A-ZÀ-Þ])(?<![\w@.+-])(?:(?P<title>{_TITLE}|{_TITLE.upper()})\b\.?\s{{1,2}})?(?:(?P<a>{_CAP}|{_BIG}),?\s{{1,2}}(?:[A-ZÀ-Þ]\.?\s{{1,2}})?)?(?P<b>{_CAP}|{_BIG})(?![\w@])"
)
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
_HAN = re.compile(r"[一-鿿]")
#: Weak forms: a number long enough for a phone or an identity, and a capital word beside a house number.
_NUMBER = re.compile(r"(?<![A-Za-z0-9.,:+/-])[+(]?\d(?:[\d()/]|[\s.\-]{1,2}(?=[\d(])){5,18}\d(?![A-Za-z0-9:,/-]|\.\d)")
#: Cheap tests that spare most texts the patterns above.
_WIDE_CHAR = re.compile(r"[\uff01-\uff5e\u3000\xa0\u202f]")
_DIGIT = re.compile(r"\d")
_DIGIT_RUN = re.compile(r"\d[\d\s().+/-]{4,}\d")
_CAPITAL, _SMALL = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]")
_AT = re.compile(r"@|[\[({<]\s*at\s*[\])}>]|\sdot\s")
#: What a street address of the forms above must hold, in small letters.
_STREET_WORDS = (
    "street", "road", "lane", "avenue", "terrace", "close", "boulevard", "blvd", "drive", "court", "place", "square", "hill", "gardens", "crescent",
    "straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "damm", "ufer", "rue", "impasse", "allée", "chemin", "quai", "cours", "passage",
    "calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "carretera", "ronda", "路", "街", "巷", "大道", "胡同", "弄",
)
#: What comes before the name of an English street, with its number.
_TO_STREET = re.compile(r".*\d[a-z]?,?\s+(?:[nsew]\.?\s+)?", re.S)
_BESIDE = re.compile(r"(?i)\b(?:st|rd|ln|ct|bd|ave|av|way|row)\b")
_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+")

_FIELDS = "src string, row_id bigint, at int, until int, type string, strong boolean, form string, one string, two string, inst string, before string, after string"


def _contexts(text: str, a: int, b: int) -> tuple[str, str]:
    left = [m.group(0) for m in _TOKEN.finditer(text, max(0, a - 40), a)][-2:]
    right = [m.group(0) for m in _TOKEN.finditer(text, b, min(len(text), b + 40))][:2]
    return " ".join(left).lower(), " ".join(right).lower()


def _narrow(text: str) -> str:
    """Full-width characters as their ASCII forms, one for one, so that places stay."""
    return text if text.isascii() or not _WIDE_CHAR.search(text) else text.translate(_WIDE)


def _mentions(text: str) -> list[tuple]:
    """(at, until, type, strong, form, one, two, inst) of the mentions in a text; places are those of the text given."""
    text = _narrow(text)
    out: list[tuple] = []
    taken = bytearray(len(text))

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\x01" * (b - a)

    low = text.lower()
    if _AT.search(low):
        for m in _EMAIL.finditer(text):
            take(*m.span())
            out.append((*m.span(), "email", True, "email", "", "", re.sub(r"[^@]+", "w", m.group(0))))
    if _DIGIT.search(text):
        runs = _DIGIT_RUN.search(text) is not None
        tried = ("street_address", _ADDRESS, any(w in low for w in _STREET_WORDS) or _BESIDE.search(low) is not None), ("phone", _PHONE, runs), ("id_number", _IDENTITY, runs)
        for kind, pattern, _ in filter(lambda t: t[2], tried):
            for m in pattern.finditer(text):
                if free(*m.span()):
                    take(*m.span())
                    if kind == "street_address":
                        # A house number before small words may count things as well ("12 quiet gardens").
                        plain = m.group("plain") is not None
                        out.append((*m.span(), "street" if plain else kind, not plain, kind, "", "", _TO_STREET.sub("", m.group(0).lower())))
                        continue
                    shape = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", m.group(0)))
                    out.append((*m.span(), kind, True, kind, "", "", shape))
        for m in _NUMBER.finditer(text) if runs else ():
            if free(*m.span()):
                out.append((*m.span(), "number", False, "number", "", "", re.sub(r"\d", "9", m.group(0))))
    # A text without capitals, or mostly of capitals, shows no names by its case; there every two words are a mention.
    capitals = len(_CAPITAL.findall(text))
    uniform = not capitals or (capitals * 4 > len(text) or len(text) < 80 or not text.isascii()) and capitals > 0.6 * (capitals + len(_SMALL.findall(text)))
    if not uniform or _HAN.search(text):
        at = 0
        while m := _NAME.search(text, at):
            a, b, title = m.group("a"), m.group("b"), m.group("title")
            at = m.end()
            if not a and not title:
                continue
            if a:
                at = m.start("b")  # the second word may begin the name proper
            if free(*m.span()):
                comma = bool(a) and "," in text[m.end("a") : m.start("b")]
                one, two = (b, a) if comma else (a or "", b)
                out.append((*m.span(), "person_name", False, ("title" if title else "pair") + ("+" if title and a else ""), one.lower(), two.lower(), f"{one} {two}".lower()))
    if uniform:
        words = list(_WORD.finditer(text))
        for x, y in zip(words, words[1:]):
            gap = text[x.end() : y.start()]
            if len(gap) <= 3 and gap.strip() in ("", ",", ".") and free(x.start(), y.end()):
                one, two = (y.group(0), x.group(0)) if "," in gap else (x.group(0), y.group(0))
                titled = re.fullmatch(_TITLE, x.group(0), re.I) is not None
                out.append((x.start(), y.end(), "person_name", False, "title" if titled else "plain", "" if titled else one.lower(), two.lower(), f"{one} {two}".lower()))
        for x, y, z in zip(words, words[1:], words[2:]):
            if len(y.group(0)) == 1 and text[x.end() : y.start()].strip() == "" and text[y.end() : z.start()].strip() in ("", "."):
                out.append((x.start(), z.end(), "person_name", False, "plain", x.group(0).lower(), z.group(0).lower(), f"{x.group(0)} {z.group(0)}".lower()))
    return out


def mentions(texts: DataFrame) -> DataFrame:
    """Mentions of (src, row_id, text) rows. Null and empty texts and null row ids have none. Whole texts, one narrow pass."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in _FIELDS.split(", ")]
        for batch in batches:
            rows = []
            for src, row_id, text in zip(batch["src"], batch["row_id"], batch["text"]):
                wide = _narrow(text)
                for at, until, kind, strong, form, one, two, inst in _mentions(text):
                    rows.append((src, row_id, at, until, kind, strong, form, one, two, inst, *_contexts(wide, at, until)))
            yield pd.DataFrame(rows, columns=columns)

    return texts.select("src", F.col("row_id").cast("bigint").alias("row_id"), "text").filter((F.length("text") > 0) & F.col("row_id").isNotNull()).mapInPandas(find, _FIELDS)


def detect(texts: DataFrame, lexicon: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(src, row_id, at, until, type) of every accepted mention in texts (src, row_id, text).

    lexicon: name_part, name_kind ('given' or 'family'), the seeds. All counts are over all texts; they are aggregated
    before they are shuffled, and the graph's size is that of the different forms and contexts, not of the texts.
    """
    found = materialize(mentions(texts), "pii-mentions")
    numbers = found.filter(F.col("type") != "person_name")
    strong = numbers.filter("strong").select("src", "row_id", "at", "until", "type")
    return strong.unionByName(_weak_numbers(numbers, rounds)).unionByName(_weak_streets(numbers, rounds)).unionByName(_names(found, lexicon, rounds))


def _patterns(edges: DataFrame) -> DataFrame:
    """One row per side of a mention that has a context; a side is one pattern."""
    sides = F.array(F.concat(F.lit("<"), F.col("before")), F.concat(F.lit(">"), F.col("after")))
    return edges.withColumn("pattern", F.explode(F.filter(sides, lambda s: F.length(s) > 2)))


def _weak_numbers(numbers: DataFrame, rounds: int) -> DataFrame:
    """Numbers of unknown form that stand where phone or identity numbers do."""
    edges = materialize(numbers.filter(F.col("type").isin("phone", "id_number", "number")).groupBy("type", "inst", "before", "after").count().drop("count"), "pii-number-edges")
    sided = _patterns(edges)
    scored = edges.filter(F.lit(False)).select("inst", F.lit("").alias("as"))
    for _ in range(rounds):
        known = sided.join(scored, "inst", "left").withColumn("is", F.when(F.col("type") != "number", F.col("type")).otherwise(F.col("as")))
        pattern = known.groupBy("pattern").agg(F.count_distinct("inst").alias("all"), *[F.count_distinct(F.when(F.col("is") == t, F.col("inst"))).alias(t) for t in ("phone", "id_number")])
        good = pattern.filter(F.col("all") >= SUPPORT).select("pattern", F.when(F.col("phone") / F.col("all") >= 0.8, "phone").when(F.col("id_number") / F.col("all") >= 0.8, "id_number").alias("as")).filter(F.col("as").isNotNull())
        # A form is learned if most of the contexts it was seen in are patterns of one type.
        seen = sided.filter(F.col("type") == "number").select("inst", "pattern").distinct().join(good, "pattern", "left")
        share = seen.groupBy("inst").agg(F.count("*").alias("n"), *[F.count_if(F.col("as") == t).alias(t) for t in ("phone", "id_number")])
        scored = materialize(share.select("inst", F.when(F.col("phone") / F.col("n") >= CONFIDENCE, "phone").when(F.col("id_number") / F.col("n") >= CONFIDENCE, "id_number").alias("as")).filter(F.col("as").isNotNull()), "pii-number-forms")
    return _as_scored(numbers.filter(F.col("type") == "number"), scored)


def _as_scored(weak: DataFrame, scored: DataFrame) -> DataFrame:
    """The weak mentions whose form was scored, under the type it got; one form may be a third of them."""
    counted = materialize(weak.groupBy("inst").agg(F.count("*").alias("n")).join(scored, "inst"), "pii-scored")
    return join_counted(weak, counted, ["inst"], "n", weak.count()).select("src", "row_id", "at", "until", F.col("as").alias("type"))


def _weak_streets(numbers: DataFrame, rounds: int) -> DataFrame:
    """Streets in small letters or capitals alone: those named elsewhere as streets, or that stand where streets do."""
    edges = materialize(numbers.filter(F.col("type").isin("street_address", "street")).select("strong", "inst", "before", "after").distinct(), "pii-street-edges")
    sided = _patterns(edges)
    named = edges.filter("strong").select("inst").distinct()
    scored = named
    for _ in range(rounds):
        known = sided.join(scored.withColumn("known", F.lit(True)), "inst", "left")
        pattern = known.groupBy("pattern").agg(F.count_distinct("inst").alias("all"), F.count_distinct(F.when(F.col("known"), F.col("inst"))).alias("hits"))
        good = pattern.filter((F.col("all") >= SUPPORT) & (F.col("hits") >= 0.8 * F.col("all"))).select("pattern", F.lit(1.0).alias("good"))
        seen = sided.select("inst", "pattern").distinct().join(good, "pattern", "left")
        learned = seen.groupBy("inst").agg(F.avg(F.coalesce("good", F.lit(0.0))).alias("share")).filter(F.col("share") >= CONFIDENCE).select("inst")
        scored = materialize(named.unionByName(learned).distinct(), "pii-streets")
    return _as_scored(numbers.filter(F.col("type") == "street"), scored.withColumn("as", F.lit("street_address")))


def _names(found: DataFrame, lexicon: DataFrame, rounds: int) -> DataFrame:
    people = found.filter(F.col("type") == "person_name")
    edges = materialize(people.groupBy("form", "one", "two", "before", "after").agg(F.count("*").alias("n")), "pii-name-edges")
    cased = edges.filter(F.col("form") != "plain")
    sided = _patterns(cased)
    parts = lexicon.select(F.lower("name_part").alias("part"), F.col("name_kind").alias("kind")).filter(F.col("part").isNotNull()).distinct()
    known, good = parts, None
    for _ in range(rounds):
        given, family = (known.filter(F.col("kind") == k).select(F.col("part").alias(c), F.lit(1).alias(k)) for k, c in (("given", "one"), ("family", "two")))
        seen = sided.join(given, "one", "left").join(family, "two", "left")
        # A pair counts by its known parts, a titled name by its family name.
        worth = F.when(F.col("one") == "", F.coalesce("family", F.lit(0)) * 1.0).otherwise((F.coalesce("given", F.lit(0)) + F.coalesce("family", F.lit(0))) / 2)
        each = seen.groupBy("pattern", "one", "two").agg(F.max(worth).alias("worth"))
        pattern = each.groupBy("pattern").agg(F.count("*").alias("all"), F.avg("worth").alias("score"))
        good = materialize(pattern.filter((F.col("all") >= SUPPORT) & (F.col("score") >= CONFIDENCE)).select("pattern", "score"), "pii-name-patterns")
        # A part is learned from two different names, or from two patterns, if most contexts it was seen in are patterns.
        taught = sided.join(good, "pattern", "left").select("pattern", "before", "after", "one", "two", F.col("score").isNotNull().alias("inside"))
        learn = taught.select("pattern", "before", "after", "inside", F.explode(F.array(F.struct(F.col("one").alias("part"), F.lit("given").alias("kind"), F.col("two").alias("mate")), F.struct(F.col("two").alias("part"), F.lit("family").alias("kind"), F.col("one").alias("mate")))).alias("x"))
        learn = learn.filter(F.col("x.part") != "").groupBy("x.part", "x.kind", "x.mate", "before", "after").agg(F.max("inside").alias("inside"), F.min(F.when(F.col("inside"), F.col("pattern"))).alias("pattern"))
        within = F.col("inside")
        learned = learn.groupBy("part", "kind").agg(F.count_distinct(F.when(within, F.col("mate"))).alias("mates"), F.count_distinct(F.when(within, F.col("pattern"))).alias("patterns"), F.avg(within.cast("double")).alias("share"))
        learned = learned.filter(((F.col("mates") >= 2) | (F.col("patterns") >= 2)) & (F.col("share") >= CONFIDENCE)).select("part", "kind")
        known = materialize(parts.unionByName(learned).distinct(), "pii-name-parts")
    given, family = (known.filter(F.col("kind") == k).select(F.col("part").alias(c), F.lit(1).alias(k)) for k, c in (("given", "one"), ("family", "two")))
    sides = edges.join(given, "one", "left").join(family, "two", "left")
    sides = sides.join(good.select(F.expr("substring(pattern, 2)").alias("before"), F.lit(1).alias("left_ok")).where("pattern like '<%'"), "before", "left")
    sides = sides.join(good.select(F.expr("substring(pattern, 2)").alias("after"), F.lit(1).alias("right_ok")).where("pattern like '>%'"), "after", "left")
    placed = F.coalesce("left_ok", "right_ok").isNotNull() & (F.col("form") != "plain")
    both = F.col("given").isNotNull() & F.col("family").isNotNull()
    half = F.col("given").isNotNull() | F.col("family").isNotNull()
    titled = (F.col("one") == "") & (F.col("family").isNotNull() | placed)
    yes = sides.filter(both | titled | (placed & (half | (F.col("left_ok").isNotNull() & F.col("right_ok").isNotNull())) & (F.col("one") != "")))
    yes = materialize(yes.select("form", "one", "two", "before", "after", "n").distinct(), "pii-names")
    return join_counted(people, yes, ["form", "one", "two", "before", "after"], "n", people.count()).select("src", "row_id", "at", "until", "type")


def redact(texts: DataFrame, accepted: DataFrame) -> DataFrame:
    """(src, row_id, text) with each accepted span replaced by its type in brackets, such as [EMAIL]; overlapping spans
    merge under the first one's type. Texts without a span, and null texts, stay as they are."""
    spans = accepted.groupBy("src", "row_id").agg(F.array_sort(F.collect_set(F.struct("at", "until", "type"))).alias("spans"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans):
            if t is None or ss is None:
                out.append(t)
                continue
            parts, end = [], 0
            for s in ss:
                if s["at"] >= end:
                    parts += [t[end : s["at"]], f"[{s['type'].upper()}]"]
                end = max(end, s["until"])
            out.append("".join(parts) + t[end:])
        return pd.Series(out, dtype=object)

    return texts.join(spans, ["src", "row_id"], "left").select("src", "row_id", replace("text", "spans").alias("text"))


def sources(records: DataFrame, log: DataFrame) -> DataFrame:
    """The free texts of both tables as (src, row_id, text)."""
    return records.select(F.lit("records_v1").alias("src"), F.col("id").alias("row_id"), F.col("content").alias("text")).unionByName(log.select(F.lit("interaction_log").alias("src"), F.col("id").alias("row_id"), F.col("user_msg").alias("text")))


def found(records: DataFrame, log: DataFrame, lexicon: DataFrame) -> DataFrame:
    accepted = detect(sources(records, log), lexicon)
    return accepted.select("src", "row_id", F.col("type").alias("pii_type")).distinct()
