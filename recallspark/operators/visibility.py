"""Who may read what: states folded from append-only events, each by one aggregation on its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.session import small


def record_state(events: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(record, owner, shared, epoch) of visibility events (event_seq, record, event_kind, target_agent, target_event_seq).

    owner: target of the last set_owner, else the anchor. shared: the last scope event is scope_shared; scope outlives a
    change of owner. epoch: grants up to it are void (last set_owner, last scope_private). One shuffle on the record,
    with map-side aggregation.
    """
    kind, seq = F.col("event_kind"), F.col("event_seq")
    owned, scoped = kind == "set_owner", kind.isin("scope_private", "scope_shared")
    return events.groupBy("record").agg(
        F.coalesce(F.max_by(F.when(owned, F.col("target_agent")), F.when(owned, seq)), F.lit(anchor)).alias("owner"),
        F.coalesce(F.max_by(F.when(scoped, kind), F.when(scoped, seq)) == "scope_shared", F.lit(False)).alias("shared"),
        F.coalesce(F.max(F.when(owned | (kind == "scope_private"), seq)), F.lit(0).cast("bigint")).alias("epoch"),
    )


def live_grants(events: DataFrame) -> DataFrame:
    """(record, agent) of grants after the epoch that no revoke targets."""
    state = record_state(events).select("record", "epoch")
    grants = events.filter(F.col("event_kind") == "grant").select("record", "event_seq", F.col("target_agent").alias("agent"))
    revoked = events.filter((F.col("event_kind") == "revoke") & F.col("target_event_seq").isNotNull()).select(F.col("target_event_seq").alias("event_seq")).distinct()
    return grants.join(state, "record").filter(F.col("event_seq") > F.col("epoch")).join(revoked, "event_seq", "left_anti").select("record", "agent").distinct()


def channels(records: DataFrame, events: DataFrame, agents: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(record, agent, channel): owner before scope_shared before grant, for each agent that may read; no row otherwise.

    agents is the bounded list of active agents. Shared records are paired with every agent; ask for few agents.
    """
    state = records.select("record").distinct().join(record_state(events, anchor), "record", "left").select("record", F.coalesce("owner", F.lit(anchor)).alias("owner"), F.coalesce("shared", F.lit(False)).alias("shared"))
    pairs = state.crossJoin(small(agents.select("agent")))
    granted = live_grants(events).withColumn("granted", F.lit(True))
    seen = pairs.join(granted, ["record", "agent"], "left")
    channel = F.when(F.col("agent") == F.col("owner"), "owner").when(F.col("shared"), "scope_shared").when(F.col("granted"), "grant")
    return seen.select("record", "agent", channel.alias("channel")).filter(F.col("channel").isNotNull())


def visible(records: DataFrame, key: str, events: DataFrame, agent: str, anchor: str = "anchor") -> DataFrame:
    """records that one agent may read; all columns stay. A semi-join before any rank or limit."""
    state = record_state(events, anchor)
    open_ = state.filter((F.col("owner") == agent) | F.col("shared")).select("record")
    granted = live_grants(events).filter(F.col("agent") == agent).select("record")
    allowed = open_.unionByName(granted).distinct().withColumnRenamed("record", key)
    seen = records.join(allowed, key, "left_semi")
    if agent == anchor:
        seen = seen.unionByName(records.join(state.select(F.col("record").alias(key)), key, "left_anti"))
    return seen


def agent_state(events: DataFrame) -> DataFrame:
    """(agent, state) of agent events (event_seq, agent, event_kind): disabled before the first 'registered'; later ones are
    ignored; 'disabled' and 're-enabled' toggle."""
    kind, seq = F.col("event_kind"), F.col("event_seq")
    first = events.groupBy("agent").agg(F.min(F.when(kind == "registered", seq)).alias("_first"))
    after = events.join(first, "agent").filter((seq > F.col("_first")) & kind.isin("disabled", "re-enabled")).groupBy("agent").agg(F.max_by(kind, seq).alias("_last"))
    state = F.when(F.col("_first").isNull() | (F.col("_last") == "disabled"), "disabled").otherwise("active")
    return first.join(after, "agent", "left").select("agent", state.alias("state"))


def credential_state(events: DataFrame) -> DataFrame:
    """(credential, state, since): revoked and expired are terminal from their first event; else the last event decides."""
    kind, seq = F.col("event_kind"), F.col("event_seq")
    terminal = kind.isin("revoked", "expired")
    folded = events.groupBy("credential").agg(F.min_by(F.when(terminal, kind), F.when(terminal, seq)).alias("t"), F.min(F.when(terminal, seq)).alias("ts"), F.max_by(kind, seq).alias("l"), F.max(seq).alias("ls"))
    last = F.when(F.col("l") == "issued", "active").otherwise(F.col("l"))
    return folded.select("credential", F.coalesce("t", last).alias("state"), F.coalesce("ts", "ls").alias("since"))


def grant(events: DataFrame, record: object, agent: str, seq: int) -> DataFrame:
    """The events with a grant appended. Events are never changed."""
    row = events.sparkSession.createDataFrame([(seq, record, "grant", agent, None)], events.select("event_seq", "record", "event_kind", "target_agent", "target_event_seq").schema)
    return events.unionByName(row, allowMissingColumns=True)


def who_can_read(record: object, events: DataFrame, agents: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Audit: (agent, via) for one record, whatever the agents' state."""
    one = events.filter(F.col("record") == F.lit(record))
    rows = agents.sparkSession.createDataFrame([(record,)], ["record"])
    return channels(rows, one, agents, anchor).select("agent", F.col("channel").alias("via"))
