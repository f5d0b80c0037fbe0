"""The facade: recall over records one agent may read, with context, coverage and provenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators import claims, context, identity, lexical, packets, visibility
from recallspark.plans import intents, planner


class Engine:
    """records: id, record_id, conversation_id, role, content, created_at, verified, authority, source_kind, source_ref;
    memberships: record_rowid, branch_id, position; events: visibility events on record_id, or None where all is open."""

    def __init__(self, records: DataFrame, memberships: DataFrame, events: DataFrame | None = None, anchor: str = "anchor") -> None:
        self.records, self.memberships, self.events, self.anchor = records, memberships, events, anchor

    def readable(self, agent: str) -> DataFrame:
        if self.events is None:
            return self.records
        return visibility.visible(self.records, "record_id", self.events, agent, self.anchor)

    def recall(self, question: str, agent: str = "anchor", limit: int = 10, as_of: datetime | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """(rank, id, record_id, tier, score, confidence, content): the first tier that has rows, ranked.

        Who may see and when are conditions before rank and limit. A question with anchors that finds none gives nothing.
        """
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        plan = planner.plan(question)
        seen = self.readable(agent)
        if as_of is not None:
            seen = seen.filter(F.col("created_at") <= F.lit(as_of))
        if start is not None:
            seen = seen.filter(F.col("created_at") >= F.lit(start))
        if end is not None:
            seen = seen.filter(F.col("created_at") < F.lit(end))
        if plan.roles:
            seen = seen.filter(F.lower(F.trim("role")).isin(*plan.roles))
        c = F.col("content")
        wanted = list(plan.any_terms)
        tier = F.when(lexical.all_terms(c, plan.anchors), 0) if plan.anchors else (
            F.when(lexical.phrase_contains(c, plan.literal), 1).when(lexical.at_least(c, wanted, max(1, len(wanted))), 2).when(lexical.at_least(c, wanted, plan.least), 3)
        )
        score = lexical.intent_score(c, required=plan.anchors, any_of=wanted, bonus=plan.bonus)
        phase = lexical.phase_priority(lexical.phase(F.col("source_kind"), F.col("source_ref")), plan.prefer_phase or "final_answer")
        hits = seen.withColumns({"tier": tier, "score": score, "phase": phase}).filter(F.col("tier").isNotNull())
        # The tier comes first in the order, so that one scan serves both the least tier and its rows: of the first rows, those
        # of the first one's tier are kept.
        order = [F.col("tier").asc(), *lexical.order_by(plan.order, "created_at", "content", "id")]
        ranked = lexical.top_k(hits, order, limit)
        ranked = ranked.withColumn("_first", F.min("tier").over(Window.partitionBy())).filter(F.col("tier") == F.col("_first"))
        sure = lexical.confidence(c, plan.literal, F.col("verified"), F.col("authority"), F.col("source_ref"))
        return ranked.select("rank", "id", "record_id", "tier", "score", sure.alias("confidence"), "content")

    def recall_projected(self, question: str, evidence: DataFrame, versions: DataFrame, agent: str = "anchor", limit: int = 10) -> DataFrame:
        """recall() with the active claims of each record, if the agent may read all of a claim's evidence; ranks stay.

        evidence: record_id, claim_id; versions: claim_id, version, status.
        """
        hits = self.recall(question, agent, limit)
        readable = claims.evidence_gate(evidence, "claim_id", "record_id", self.readable(agent), "record_id").filter("readable").select("claim_id")
        noted = claims.annotate(hits, "record_id", evidence, versions.join(readable, "claim_id", "left_semi"))
        each = noted.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("claim_id", "version"))).alias("claims"))
        return hits.join(each, "record_id", "left").select(*hits.columns, "claims")

    def context(self, hits: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
        """The hits' neighbours on their branches, whatever the time scope."""
        placed = self.memberships.join(hits.select(F.col("id").alias("record_rowid")), "record_rowid")
        return context.window_join(placed, self.memberships, before, after)

    def coverage(self, agent: str = "anchor") -> DataFrame:
        return claims.coverage(self.readable(agent), "created_at", "source_cutoff_at", "verified", "source_kind")

    def adaptive_recall(self, question: str, agent: str = "anchor", limit: int = 10, reference: datetime | None = None, policy: planner.RescuePolicy | None = None) -> list[str]:
        """record_ids of the question's passes, at most four, merged in turn. Results are bounded by 4 x limit rows."""
        if planner.needs_clarification(question):
            return []
        scope = planner.calendar_scope(question, reference)
        bounds = {"start": scope.start, "end": scope.end} if scope and scope.start else {}
        todo = [("initial", question), *planner.follow_up_passes(question)]
        todo += [("rescue", q) for q in planner.rescue_passes(question, policy)] if policy else []
        passes = []
        for name, query in todo[: planner.MAX_PASSES]:
            passes.append((name, [r["record_id"] for r in self.recall(query, agent, limit, **bounds).orderBy("rank").select("record_id").collect()]))
        return planner.merge_round_robin(passes, limit)

    def ask(self, question: str, agent: str = "anchor", limit: int = 10) -> DataFrame:
        """(rank, id, record_id, tier, tier_name, score, content): the first of all nine tiers that has rows, by the question's
        intent; rows the agent may not read are gone before any tier is tried."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        wanted = intents.intent(question)
        seen = self.readable(agent)
        if wanted.roles:
            seen = seen.filter(F.lower(F.trim("role")).isin(*wanted.roles))
        asked = self.records.sparkSession.createDataFrame([intents.question_row("q", question)], lexical.QUESTION)
        hits = lexical.full_cascade(seen, "id", "content", asked, limit)
        return hits.join(seen.select(F.col("id").alias("key"), "record_id", "content"), "key").select("rank", F.col("key").alias("id"), "record_id", "tier", "tier_name", "score", "content")

    def debug(self, question: str, groups: DataFrame, agent: str = "anchor", limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """recall() and, of its wider candidates, those that weren't selected with the reason. groups: (record_id, group_id)."""
        pool = self.recall(question, agent, min(100, intents.inner_limit(limit) * 3))
        top = pool.filter(F.col("rank") <= limit)
        chosen = top.select("record_id", F.col("rank").alias("position")).groupBy("record_id").agg(F.min("position").alias("position"))
        return top, packets.exclusions(pool, chosen, groups, "record_id")

    def trace(self, question: str, agent: str = "anchor", limit: int = 20) -> DataFrame:
        """(id, score, rank): where the wording of the first hits stands first, by their literal anchors."""
        hits = self.recall(question, agent, intents.inner_limit(limit))
        return lexical.original_trace(self.readable(agent), "id", "content", "created_at", lexical.trace_anchors(hits, "content"), limit)

    def event_collection(self, question: str, agent: str = "anchor") -> DataFrame | None:
        """The packet of a question for several occurrences; None for another question."""
        wanted = intents.event_intent(question)
        if wanted is None:
            return None
        return packets.event_collection(self.readable(agent), "record_id", "created_at", "content", [wanted.subject])

    def guard(self, question: str, agent: str = "anchor") -> dict:
        """Whether the question states a date after all that was imported."""
        last = self.readable(agent).agg(F.max("created_at")).first()[0]
        return intents.coverage_guard(question, last.date() if last is not None else None)

    # Administration

    def identity(self, agents: DataFrame) -> identity.Ledger:
        """Writers of owners, scopes and grants; agents: (agent, state)."""
        if self.events is None:
            raise ValueError("the engine has no visibility events")
        return identity.Ledger(self.events, self.records, agents, "record_id", self.anchor)

    def audit(self, record: object, agents: DataFrame) -> DataFrame:
        """(agent, via): who can read one record."""
        if self.events is None:
            raise ValueError("the engine has no visibility events")
        return visibility.who_can_read(record, self.events, agents, self.anchor)

    def rebuild_index(self, path: str) -> int:
        return lexical.rebuild(self.records, "id", "content", path)

    def check_index(self, path: str) -> DataFrame:
        """One row: records of three characters or more without an index entry, and entries without a record."""
        indexed = self.records.filter(F.length("content") >= 3)
        return lexical.index_consistency(indexed, "id", self.records.sparkSession.read.parquet(path), "key")
