"""Writers and audits of visibility events. Events are only appended; each writer validates, then adds one row."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators import visibility

#: Columns of the visibility events.
EVENT = "event_seq bigint, record string, event_kind string, target_agent string, target_event_seq bigint"


def fold_state(events: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(record, owner, shared, epoch) as visibility.record_state gives it, in the form of a replay: each event carries the
    state after it, and the last one's counts. Its windows sort one record's events; record_state aggregates them."""
    kind, seq = F.col("event_kind"), F.col("event_seq")
    so_far = Window.partitionBy("record").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    after = events.select(
        "record", "event_seq",
        F.last(F.when(kind == "set_owner", F.struct("target_agent")), ignorenulls=True).over(so_far).alias("o"),
        F.last(F.when(kind.isin("scope_private", "scope_shared"), kind), ignorenulls=True).over(so_far).alias("s"),
        F.last(F.when(kind.isin("set_owner", "scope_private"), seq), ignorenulls=True).over(so_far).alias("e"),
        F.row_number().over(Window.partitionBy("record").orderBy(F.col("event_seq").desc())).alias("back"),
    )
    last = after.filter("back = 1")
    return last.select("record", F.coalesce("o.target_agent", F.lit(anchor)).alias("owner"), F.coalesce(F.col("s") == "scope_shared", F.lit(False)).alias("shared"), F.coalesce("e", F.lit(0).cast("bigint")).alias("epoch"))


def effective_grants(events: DataFrame) -> DataFrame:
    """(record, agents): the agents that live grants let read a record, comma-joined in order; records without any are left
    out. A record has at most as many as there are agents."""
    return visibility.live_grants(events).groupBy("record").agg(F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"))


class Ledger:
    """Visibility events with the records and agents they may name. Writers return a new ledger; events never change."""

    def __init__(self, events: DataFrame, records: DataFrame, agents: DataFrame, key: str = "record_id", anchor: str = "anchor") -> None:
        """agents: (agent, state), as visibility.agent_state gives it."""
        self.events, self.records, self.agents, self.key, self.anchor = events, records, agents, key, anchor

    def _check(self, record: object, agent: str | None) -> None:
        if not self.records.filter(F.col(self.key) == F.lit(record)).limit(1).count():
            raise ValueError("unknown record")
        if agent is not None and not self.agents.filter((F.col("agent") == agent) & (F.col("state") == "active")).limit(1).count():
            raise ValueError("unknown or disabled agent")

    def _append(self, record: object, kind: str, agent: str | None = None, target: int | None = None) -> Ledger:
        last = self.events.agg(F.max("event_seq")).first()[0] or 0
        kept = self.events.select("event_seq", "record", "event_kind", "target_agent", "target_event_seq")
        row = self.events.sparkSession.createDataFrame([(last + 1, record, kind, agent, target)], kept.schema)
        return Ledger(kept.unionByName(row), self.records, self.agents, self.key, self.anchor)

    def _state(self, record: object) -> dict:
        one = visibility.record_state(self.events.filter(F.col("record") == F.lit(record)), self.anchor).first()
        return one.asDict() if one else {"owner": self.anchor, "shared": False, "epoch": 0}

    def set_owner(self, record: object, agent: str) -> Ledger:
        """A new owner, or the same one again; either way grants made before are void from here."""
        self._check(record, agent)
        return self._append(record, "set_owner", agent)

    def set_scope(self, record: object, shared: bool) -> Ledger:
        """Shared with all agents, or private; private voids the grants made before."""
        self._check(record, None)
        return self._append(record, "scope_shared" if shared else "scope_private")

    def grant(self, record: object, agent: str) -> Ledger:
        """Lets an agent read. The owner, or an agent that has a live grant, needs none: that is an error."""
        self._check(record, agent)
        if self._state(record)["owner"] == agent:
            raise ValueError("the owner reads already")
        if visibility.live_grants(self.events.filter(F.col("record") == F.lit(record))).filter(F.col("agent") == agent).limit(1).count():
            raise ValueError("granted already")
        return self._append(record, "grant", agent)

    def revoke(self, record: object, grant_seq: int) -> Ledger:
        """Takes back one grant of the current epoch; another event, an older epoch or a second revoke is an error."""
        self._check(record, None)
        mine = self.events.filter(F.col("record") == F.lit(record))
        if not mine.filter((F.col("event_seq") == grant_seq) & (F.col("event_kind") == "grant")).limit(1).count():
            raise ValueError("no such grant")
        if grant_seq <= self._state(record)["epoch"]:
            raise ValueError("the grant is of an epoch before")
        if mine.filter((F.col("event_kind") == "revoke") & (F.col("target_event_seq") == grant_seq)).limit(1).count():
            raise ValueError("revoked already")
        return self._append(record, "revoke", None, grant_seq)


# Audits --------------------------------------------------------------------------------------------------------------------


def history(events: DataFrame, record: object) -> DataFrame:
    """The events of one record in order."""
    return events.filter(F.col("record") == F.lit(record)).orderBy("event_seq")


def agent_report(agents: DataFrame, events: DataFrame) -> DataFrame:
    """(agent, state, owned, granted): of each agent (agent, state) the records it owns by event and those live grants let it
    read."""
    owned = visibility.record_state(events).groupBy(F.col("owner").alias("agent")).agg(F.count("*").alias("owned"))
    granted = visibility.live_grants(events).groupBy("agent").agg(F.count("*").alias("granted"))
    joined = agents.select("agent", "state").join(owned, "agent", "left").join(granted, "agent", "left")
    return joined.select("agent", "state", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("granted", F.lit(0)).alias("granted"))


def resolve_principal(token: str | None, credentials: DataFrame, states: DataFrame, agents: DataFrame) -> str:
    """The agent of a token, for callers outside queries. credentials: (credential, agent, token_hash); states: (credential,
    state); agents: (agent, state). PermissionError unless credential and agent are both active; tokens are compared as
    SHA-256, LookupError where there are no credentials at all."""
    if not credentials.limit(1).count():
        raise LookupError("no credentials are set up")
    if not token:
        raise PermissionError("no token")
    digest = hashlib.sha256(token.encode()).hexdigest()
    found = credentials.filter(F.col("token_hash") == digest).join(states.filter("state = 'active'"), "credential").join(agents.filter("state = 'active'").select("agent"), "agent")
    row = found.select("agent").first()
    if row is None:
        raise PermissionError("unknown or inactive")
    return row[0]


def clamp_updates(updates: DataFrame, key: str, seq: str, fields: dict[str, float]) -> DataFrame:
    """(key, fields): the last update of each key with its values within 0 and 1; a field that the last update leaves null
    falls back to its default, as a replaced row does."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("_l"))
    return last.select(key, *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(f"_l.{c}"), F.lit(default)))).alias(c) for c, default in fields.items()])
