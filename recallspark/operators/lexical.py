"""Tiered lexical search: predicates, scores, orders, BM25 over trigrams, and the tier cascade for batches of questions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import like_contains, phrase_contains, phrase_count
from recallspark.session import small

#: Rank orders, each ending with a total key. s: score, p: phase priority, t: time, n: content length, id: key.
ORDERS = {
    "fts": ("score_asc", "phase", "time", "id"),
    "like": ("score", "phase", "time_desc", "id"),
    "relevance_oldest": ("score", "phase", "time", "length", "id"),
    "oldest": ("time", "score", "phase", "length", "id"),
    "latest": ("time_desc", "score", "phase", "length", "id"),
    "compact": ("length", "score", "phase", "time_desc", "id"),
    "default": ("score", "phase", "length", "time_desc", "id"),
    "trace": ("time", "score", "length", "id"),
}


def order_by(name: str, time: str, content: str, key: str, score: str = "score", phase: str = "phase") -> list[Column]:
    parts = {"score": F.col(score).desc(), "score_asc": F.col(score).asc(), "phase": F.col(phase).desc(), "time": F.col(time).asc(), "time_desc": F.col(time).desc(), "length": F.length(content).asc(), "id": F.col(key).asc()}
    return [parts[p] for p in ORDERS[name]]


def all_terms(text: Column, terms: Sequence[str]) -> Column:
    return reduce(and_, [like_contains(text, t) for t in terms], F.lit(True))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    return reduce(or_, [like_contains(text, t) for t in terms], F.lit(False))


def term_score(text: Column, terms: Sequence[str]) -> Column:
    """Number of the terms a text has."""
    return reduce(add, [like_contains(text, t).cast("int") for t in terms], F.lit(0))


def at_least(text: Column, terms: Sequence[str], least: int) -> Column:
    return term_score(text, terms) >= least


def intent_score(text: Column, required: Sequence[str] = (), any_of: Sequence[str] = (), bonus: Sequence[str] = (), priority: Sequence[str] = (), weight: int | None = None, as_group: bool = False) -> Column:
    """Required and optional terms count one each (or the optional ones as a group), priority terms count by weight."""
    weight = weight if weight is not None else max(2, len(bonus) + 1)
    optional = any_term(text, any_of).cast("int") if as_group and any_of else term_score(text, any_of)
    return term_score(text, required) + optional + term_score(text, bonus) + term_score(text, priority) * weight


def phase(source_kind: Column, source_ref: Column, kinds: Sequence[str] = ("official-zip", "agent-log")) -> Column:
    """What part of an answer a record is, from its reference; null where its source doesn't tell."""
    out = F.lit(None).cast("string")
    for name in ("reasoning_recap", "thoughts", "commentary", "final_answer"):
        out = F.when(source_kind.isin(*kinds) & F.contains(source_ref, F.lit(f"phase={name}")), name).otherwise(out)
    return out


def phase_priority(phase_: Column, prefer: str = "final_answer") -> Column:
    return F.when(phase_ == prefer, 2).when(phase_.isNull(), 1).otherwise(0)


def confidence(text: Column, literal: str, verified: Column, authority: Column, source_ref: Column, trusted: Sequence[str] = ("official",)) -> Column:
    """0.50, and 0.20 for the exact wording, 0.15 if verified, 0.10 for a trusted authority, 0.05 with a reference; at most 1."""
    value = F.lit(0.5) + F.when(F.contains(text, F.lit(literal)), 0.2).otherwise(0.0) + F.when(F.coalesce(verified, F.lit(False)), 0.15).otherwise(0.0)
    value = value + F.when(authority.isin(*trusted), 0.1).otherwise(0.0) + F.when(F.length(source_ref) > 0, 0.05).otherwise(0.0)
    return F.round(F.least(value, F.lit(1.0)), 2)


def confidence_reasons(text: Column, literal: str, verified: Column, authority: Column, source_ref: Column, trusted: Sequence[str] = ("official",)) -> Column:
    reasons = [F.when(F.contains(text, F.lit(literal)), "exact_wording"), F.when(verified, "verified"), F.when(authority.isin(*trusted), "trusted_authority"), F.when(F.length(source_ref) > 0, "has_reference")]
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def top_k(df: DataFrame, order: Sequence[Column], k: int, per: Sequence[str] = ()) -> DataFrame:
    """The first k rows, of each group if groups are named; rank is added. A group's limit is pushed below its sort."""
    if not per:
        # A limit first, so that the rank's one-task window only sees k rows.
        best = df.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, key: str, text: str, phrases: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs with score, lower is better, as phrase search over trigrams ranks them; rows without a phrase are left out.

    Number of rows, mean length and document frequencies are those of all docs, before any filter on what may be seen:
    one aggregate of one row, joined back. Length is the number of trigrams; idf is floored at 1e-6.
    """
    phrases = [p for p in dict.fromkeys(phrases) if len(p) >= 3]
    if not phrases:
        return docs.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    length = F.greatest(F.length(F.col(text)) - 2, F.lit(0))
    counted = docs.withColumns({f"_f{i}": phrase_count(F.col(text), p) for i, p in enumerate(phrases)} | {"_len": length})
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("bigint")).alias(f"_df{i}") for i in range(len(phrases))])
    joined = counted.filter(reduce(or_, [F.col(f"_f{i}") > 0 for i in range(len(phrases))])).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"_f{i}")
        score = score - idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return joined.withColumn("score", score).select(*docs.columns, "score")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key, tf, positions): the trigram index for archives too large to scan; positions count from 0."""
    from recallspark.functions.text import grams

    each = docs.select(F.col(key).alias("key"), F.posexplode(grams(F.col(text))).alias("pos", "gram"))
    return each.groupBy("gram", "key").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def search_postings(index: DataFrame, phrase: str) -> DataFrame:
    """(key, n) of the texts that have the phrase, by adjacent positions of its trigrams; no text is read."""
    low = phrase.lower()
    wanted = [low[i : i + 3] for i in range(len(low) - 2)]
    if not wanted:
        return index.select("key", F.lit(0).alias("n")).filter(F.lit(False))
    spark = index.sparkSession
    steps = spark.createDataFrame([(g, i) for i, g in enumerate(wanted)], "gram string, step int")
    starts = index.join(F.broadcast(steps), "gram").select("key", F.explode(F.transform("positions", lambda p: p - F.col("step"))).alias("start"), "step")
    whole = starts.groupBy("key", "start").agg(F.count("*").alias("steps")).filter(F.col("steps") == len(wanted))
    return whole.groupBy("key").agg(F.count("*").cast("int").alias("n"))


def index_consistency(docs: DataFrame, key: str, index: DataFrame, index_key: str) -> DataFrame:
    """One row: keys without an index entry, and index entries without a key."""
    a, b = docs.select(F.col(key).alias("k")).distinct(), index.select(F.col(index_key).alias("k")).distinct()
    missing = a.join(b, "k", "left_anti").agg(F.count("*").alias("missing"))
    orphaned = b.join(a, "k", "left_anti").agg(F.count("*").alias("orphaned"))
    return missing.crossJoin(orphaned)


def relaxed(text: Column, ascii_terms: Sequence[str], cjk_terms: Sequence[str]) -> Column:
    """All of the ASCII terms and one of the others, as phrases."""
    left = reduce(and_, [phrase_contains(text, t) for t in ascii_terms], F.lit(True))
    right = reduce(or_, [phrase_contains(text, t) for t in cjk_terms], F.lit(False)) if cjk_terms else F.lit(True)
    return left & right


def cascade(docs: DataFrame, key: str, text: str, questions: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, key, tier, score, rank): per question only the rows of its first tier that has any.

    questions: question_id, literal, anchors (array), any_terms (array). Tiers: 0 all anchors; then, unless the question has
    anchors (which suppress all generic tiers), 1 the literal phrase, 2 all any_terms, 3 one of them. questions is a batch of
    bounded size, replicated to each task; one scan of docs serves the whole batch, and the least tier per question is a
    small aggregate.
    """
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(key).alias("key"), low.alias("low")).crossJoin(small(questions, 10_000))
    has = lambda t: F.contains(F.col("low"), F.lower(t))
    anchored = F.size("anchors") > 0
    score = F.size(F.filter("any_terms", has)) + F.size(F.filter("anchors", has))
    tier = (
        F.when(anchored & F.forall("anchors", has), 0)
        .when(anchored, F.lit(None).cast("int"))
        .when((F.length("literal") >= 3) & has(F.col("literal")), 1)
        .when((F.size("any_terms") > 0) & F.forall("any_terms", has), 2)
        .when(F.exists("any_terms", has), 3)
    )
    hits = rows.select("question_id", "key", tier.alias("tier"), score.alias("score")).filter(F.col("tier").isNotNull())
    best = hits.groupBy("question_id").agg(F.min("tier").alias("tier"))
    ranked = hits.join(best, ["question_id", "tier"])
    return top_k(ranked, [F.col("score").desc(), F.col("key").asc()], k, ["question_id"]).select("question_id", "key", "tier", "score", "rank")


# Traces and shared events --------------------------------------------------------------------------------------------------

#: How many anchors a trace follows, how long they are, and how many candidates of a shared event are looked at.
MAX_TRACE_ANCHORS, TRACE_CHARS, MAX_EVENT_CANDIDATES = 8, (8, 120), 200
#: The two forms of quotation a trace follows, list marks, and blanks and quotes round an anchor.
QUOTATIONS = (r"[“「『]([^”」』]{8,120})[”」』]", r'"([^"\r\n]{8,120})"')
LIST_MARK, ROUND = r"^\s*(?:[-*•>]+|\d+[.)、])\s*", r"^[\s'\"“”「」『』]+|[\s'\"“”「」『』]+$"


def trace_anchors(hits: DataFrame, text: str, most: int = MAX_TRACE_ANCHORS) -> list[str]:
    """Literal anchors in the texts of a bounded result list: what stands in quotes first, else lines, longer ones first.

    An anchor has 8 to 120 characters, 8 of them letters or digits, and isn't a heading that ends with a colon; list marks
    and quotes round it go. Found in Catalyst, `most` of them spread over the order are kept.
    """
    from recallspark.plans.planner import sample_evenly

    low, high = TRACE_CHARS
    quoted = F.concat(*[F.regexp_extract_all(F.col(text), F.lit(form), F.lit(1)) for form in QUOTATIONS])
    lines = F.split(F.col(text), r"\r?\n")
    bare = lambda p: F.regexp_replace(F.regexp_replace(p, LIST_MARK, ""), ROUND, "")
    tag = lambda parts, rank: F.transform(parts, lambda p: F.struct(F.lit(rank).alias("rank"), bare(p).alias("anchor")))
    each = hits.filter(F.col(text).isNotNull()).select(F.explode(F.concat(tag(quoted, 0), tag(lines, 1))).alias("x")).select("x.rank", F.regexp_replace("x.anchor", r"\s+", " ").alias("anchor"))
    lexical_chars = F.length(F.regexp_replace("anchor", r"[^\p{L}\p{N}]", ""))
    kept = each.filter(F.length("anchor").between(low, high) & (lexical_chars >= low) & ~F.col("anchor").rlike("[:：]$")).groupBy(F.lower("anchor").alias("folded")).agg(F.min("rank").alias("rank"), F.min("anchor").alias("anchor"))
    ordered = kept.orderBy("rank", F.length("anchor").desc(), "anchor").select("anchor").collect()
    return sample_evenly([r.anchor for r in ordered], most)


def anchor_counts(docs: DataFrame, text: str, anchors: Sequence[str], least: int = 2) -> DataFrame:
    """(anchor, n) of the anchors that at least `least` texts hold: one pass, one row of counters, turned into rows."""
    if not anchors:
        return docs.sparkSession.createDataFrame([], "anchor string, n bigint")
    counts = docs.agg(*[F.coalesce(F.sum(like_contains(F.col(text), a).cast("bigint")), F.lit(0)).alias(f"_{i}") for i, a in enumerate(anchors)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("anchor"), F.col(f"_{i}").alias("n")) for i, a in enumerate(anchors)]))
    return counts.select(each.alias("x")).select("x.*").filter(F.col("n") >= least)


def original_trace(docs: DataFrame, key: str, text: str, time: str, anchors: Sequence[str], limit: int = 20) -> DataFrame:
    """(key, score, rank): the rows that hold two of the anchors (one, if only one is followed), oldest first.

    An anchor that only one row holds leads nowhere else and isn't followed."""
    followed = [r.anchor for r in anchor_counts(docs, text, anchors).collect()]
    rows = docs.select(key, F.col(time).alias("_time"), F.col(text).alias("_text")).withColumn("score", term_score(F.col("_text"), followed))
    found = rows.filter(F.col("score") >= (2 if len(followed) > 1 else 1)) if followed else rows.filter(F.lit(False))
    return top_k(found, order_by("trace", "_time", "_text", key), limit).select(key, "score", "rank")


def event_candidates(docs: DataFrame, key: str, text: str, time: str, anchors: Sequence[str], dyadic: Sequence[str], limit: int = MAX_EVENT_CANDIDATES) -> DataFrame:
    """(key, prioritized, rank, truncated): rows that hold an anchor of a shared event, those with a word of two people first.

    One scan. Each of the two classes is ordered by time and key and told up to `limit`; those of the second class fill up
    what the first leaves of it. truncated: a class has more."""
    found = docs.filter(any_term(F.col(text), anchors)).select(key, F.col(time).alias("_time"), any_term(F.col(text), dyadic).alias("prioritized"))
    order = [F.col("_time").asc_nulls_last(), F.col(key).asc()]
    first = [found.filter(side).orderBy(*order).limit(limit + 1) for side in (F.col("prioritized"), ~F.col("prioritized"))]
    both = first[0].unionByName(first[1])
    sizes = both.groupBy("prioritized").count().agg(F.coalesce(F.bool_or(F.col("count") > limit), F.lit(False)).alias("truncated"))
    ranked = both.withColumn("rank", F.row_number().over(Window.orderBy(F.col("prioritized").desc(), *order))).filter(F.col("rank") <= limit)
    return ranked.crossJoin(F.broadcast(sizes)).select(key, "prioritized", "rank", "truncated")


#: The tiers of full_cascade, in order.
TIERS = ("anchored_intent", "exact_phrase", "intent", "focused_phrases", "focused_relaxed", "focused_terms", "relaxed", "terms", "literal")
#: The columns of its questions.
QUESTION = (
    "question_id string, literal string, exact array<string>, anchored boolean, required array<string>, optional array<string>, least int, bonus array<string>, "
    "focused array<string>, focused_ascii array<string>, focused_other array<string>, focused_terms array<string>, wide_ascii array<string>, wide_other array<string>, wide_terms array<string>"
)
#: Questions that one scan answers.
QUESTIONS_PER_SCAN = 500


def full_cascade(docs: DataFrame, key: str, text: str, questions: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, key, tier, tier_name, score, rank): per question the rows of its first tier that has any.

    questions: QUESTION. Tiers: intent (all required terms and at least `least` optional ones), before all others where the
    question is anchored, and then nothing else; an exact phrase; intent; all focused phrases; relaxed focused phrases (all
    ASCII ones, one of the others); one focused term; relaxed phrases; one term; the literal. Phrases fold Unicode case and
    have three characters or more, terms fold ASCII case. score: required, optional and bonus terms that the text has.
    Empty lists make no tier; null texts match nothing.

    All tiers of a batch of questions are tested in one scan; a longer batch takes one scan per QUESTIONS_PER_SCAN of it, so
    that what is broadcast stays bounded.
    """
    scans = max(1, -(-questions.count() // QUESTIONS_PER_SCAN))
    # The questions are the caller's own, a few strings each; they are dealt evenly to the scans.
    numbered = [(r, i % scans) for i, r in enumerate(questions.select([c.split()[0] for c in QUESTION.split(", ")]).orderBy("question_id").collect())]
    hits = None
    for scan in range(scans):
        part = docs.sparkSession.createDataFrame([tuple(r) for r, s in numbered if s == scan], QUESTION)
        found = _tiers(docs, key, text, part)
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("question_id").agg(F.min("tier").alias("tier"))
    ranked = top_k(hits.join(best, ["question_id", "tier"]), [F.col("score").desc(), F.col("key").asc()], k, ["question_id"])
    return ranked.select("question_id", "key", "tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1).alias("tier_name"), "score", "rank")


def _tiers(docs: DataFrame, key: str, text: str, questions: DataFrame) -> DataFrame:
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("ascii"), F.lower(F.col(text)).alias("low"))
    asked = questions.select(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower).alias(c) if c in _LISTS else F.col(c) for c in questions.columns])
    rows = rows.crossJoin(F.broadcast(asked))
    term = lambda t: F.contains(F.col("ascii"), t)
    phrase = lambda t: (F.length(t) >= 3) & F.contains(F.col("low"), t)
    some = lambda c: F.size(c) > 0
    count = lambda c: F.size(F.filter(c, term))
    relaxed_ = lambda a, o: (some(a) | some(o)) & F.forall(a, phrase) & (~some(o) | F.exists(o, phrase))
    intent = (some("required") | some("optional")) & F.forall("required", term) & (~some("optional") | (count("optional") >= F.col("least")))
    anchored = F.coalesce("anchored", F.lit(False))
    tests = [anchored & intent, F.exists("exact", phrase), intent, some("focused") & F.forall("focused", phrase), relaxed_("focused_ascii", "focused_other"), F.exists("focused_terms", term), relaxed_("wide_ascii", "wide_other"), F.exists("wide_terms", term), (F.length("literal") > 0) & term(F.lower("literal"))]
    tier = F.when(tests[0], 0).when(anchored, F.lit(None).cast("int"))
    for number, test in enumerate(tests[1:], 1):
        tier = tier.when(test, number)
    found = rows.select("question_id", "key", tier.alias("tier"), (count("required") + count("optional") + count("bonus")).alias("score"))
    return found.filter(F.col("tier").isNotNull())


_LISTS = {part.split()[0] for part in QUESTION.split(", ") if part.endswith("array<string>")}


def rebuild(docs: DataFrame, key: str, text: str, path: str) -> int:
    """Writes the trigram index of docs anew, in place of the one at path; the number of its rows."""
    postings(docs, key, text).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path).count()


def by_ids(records: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """The records that ids name, all columns; repeated and null ids name nothing more."""
    return records.join(ids.select(F.col(id_).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")
