"""Versioned claims on evidence, conflicts between them, and their freshness. States are derived, never updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.plans.skew import numbered


def canonical_id(prefix: str, *parts: Column) -> Column:
    """prefix and 24 hex digits of the SHA-256 of the parts as a compact JSON array."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 24))


def set_hash(df: DataFrame, by: list[str], key: str, value: str, out: str = "set_hash") -> DataFrame:
    """SHA-256 over the sorted (key, value) pairs of each group as compact JSON."""
    pairs = F.array_sort(F.collect_set(F.array(F.col(key).cast("string"), F.col(value).cast("string"))))
    return df.groupBy(*by).agg(F.sha2(F.to_json(pairs), 256).alias(out))


def sequence_hash(df: DataFrame, by: list[str], order: str, value: str, out: str = "sequence_hash") -> DataFrame:
    """SHA-256 over the values of each group in order, one per line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return df.groupBy(*by).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias(out))


def versions(statements: DataFrame, claim: list[str], order: list[str]) -> DataFrame:
    """statements with version from 1 and status: the last version of a claim is active, the ones before superseded.

    A claim with very many statements is numbered in parts; its last version is found by an aggregation."""
    placed = numbered(statements, claim, order, "version")
    last = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in claim]).agg(F.max("version").alias("_last"))
    same = F.lit(True)
    for c in claim:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(last, same).withColumn("status", F.when(F.col("version") == F.col("_last"), "active").otherwise("superseded")).select(*placed.columns, "status")


def changed_only(statements: DataFrame, claim: list[str], order: list[str], value: str) -> DataFrame:
    """Statements that differ from the one before them: saying the same again makes no version."""
    before = F.lag(value).over(Window.partitionBy(*claim).orderBy(*order))
    return statements.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def chain_breaks(versioned: DataFrame, claim: list[str]) -> DataFrame:
    """Versions that aren't one more than the version before them, or start above 1."""
    before = F.coalesce(F.lag("version").over(Window.partitionBy(*claim).orderBy("version")), F.lit(0))
    return versioned.withColumn("_before", before).filter(F.col("version") != F.col("_before") + 1).drop("_before")


def evidence_gate(evidence: DataFrame, claim: str, record: str, visible: DataFrame, visible_key: str) -> DataFrame:
    """(claim, n_evidence, readable): a claim is readable if it has evidence and all of it is visible."""
    seen = visible.select(F.col(visible_key).alias(record)).distinct().withColumn("_seen", F.lit(True))
    return evidence.join(seen, record, "left").groupBy(claim).agg(F.count("*").alias("n_evidence"), F.bool_and(F.coalesce("_seen", F.lit(False))).alias("readable"))


def freshness(links: DataFrame, claim: str, record: str, stored_hash: str, current: DataFrame, current_key: str, current_hash: str) -> DataFrame:
    """(claim, state): no_evidence, missing_evidence, stale (a hash differs) or fresh."""
    now = current.select(F.col(current_key).alias(record), F.col(current_hash).alias("_now")).dropDuplicates([record])
    joined = links.join(now, record, "left").groupBy(claim).agg(F.count(record).alias("linked"), F.count("_now").alias("found"), F.coalesce(F.bool_or(F.col(stored_hash) != F.col("_now")), F.lit(False)).alias("differs"))
    return joined.select(claim, F.when(F.col("linked") == 0, "no_evidence").when(F.col("found") < F.col("linked"), "missing_evidence").when(F.col("differs"), "stale").otherwise("fresh").alias("state"))


def conflict_status(conflicts: DataFrame, decisions: DataFrame, key: str = "conflict_id", seq: str = "seq") -> DataFrame:
    """(conflict, status): open without a decision or if the last one is unresolved, else what it says."""
    last = decisions.groupBy(key).agg(F.max_by("decision", seq).alias("_last"))
    return conflicts.select(key).distinct().join(last, key, "left").select(key, F.when(F.col("_last").isNull() | (F.col("_last") == "unresolved"), "open").otherwise(F.col("_last")).alias("status"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; null keys are orphans too."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def coverage(records: DataFrame, at: str, cutoff: str, verified: str, kind: str, patch: str = "recent_patch") -> DataFrame:
    """One row: the last verified cutoff (patches never move it), the last time, the number, and patches beyond the cutoff."""
    counted = F.col(verified) & (F.col(kind) != patch)
    one = records.agg(F.max(F.when(counted, F.col(cutoff))).alias("verified_cutoff"), F.max(at).alias("last_at"), F.count("*").alias("n_records"), F.max(F.when(F.col(kind) == patch, F.col(at))).alias("_patch"))
    return one.select("verified_cutoff", "last_at", "n_records", F.coalesce((F.col("_patch") > F.col("verified_cutoff")) | (F.col("_patch").isNotNull() & F.col("verified_cutoff").isNull()), F.lit(False)).alias("has_recent_patch"))


def coverage_state(n: Column, cutoff: Column, as_of: Column) -> Column:
    """The coverage ladder, first match wins."""
    return F.when(n == 0, "no_visible_records").when(cutoff.isNull(), "verified_cutoff_unknown").when(as_of.isNull(), "not_assessed_without_as_of").when(as_of > cutoff, "outside_verified_cutoff").otherwise("within_verified_cutoff")


def register_conflicts(members: DataFrame, decisions: DataFrame, key: str = "conflict_id") -> DataFrame:
    """members (conflict, claim) that may be added: of conflicts with two or more different claims and no decision yet."""
    real = members.groupBy(key).agg(F.count_distinct("claim_id").alias("_n")).filter("_n >= 2").select(key)
    return members.distinct().join(real, key, "left_semi").join(decisions.select(key), key, "left_anti")


def record_decisions(decisions: DataFrame, new: DataFrame, key: str = "conflict_id") -> DataFrame:
    """decisions with new ones appended; an id is made of the conflict, the decision and its target, so that saying the same
    again adds nothing."""
    named = lambda df: df.withColumn("decision_id", canonical_id("dec-", F.col(key), F.col("decision"), F.coalesce("target", F.lit(""))))
    old, fresh = named(decisions), named(new).dropDuplicates(["decision_id"])
    return old.unionByName(fresh.join(old.select("decision_id"), "decision_id", "left_anti"), allowMissingColumns=True)


def mask_conflicts(members: DataFrame, readable: DataFrame, key: str = "conflict_id") -> DataFrame:
    """(conflict, n_members, readable): a conflict may be shown if all of its claims may be read."""
    seen = readable.filter("readable").select("claim_id").distinct().withColumn("_seen", F.lit(True))
    return members.distinct().join(seen, "claim_id", "left").groupBy(key).agg(F.count("*").alias("n_members"), F.bool_and(F.coalesce("_seen", F.lit(False))).alias("readable"))


def annotate(records: DataFrame, record: str, evidence: DataFrame, versioned: DataFrame) -> DataFrame:
    """(record, claim_id, version) of the active claims that each record is evidence of; records keep their order elsewhere."""
    active = versioned.filter("status = 'active'").select("claim_id", "version")
    return records.select(record).join(evidence.select(record, "claim_id"), record).join(active, "claim_id").select(record, "claim_id", "version")


# Projection runs and reads -------------------------------------------------------------------------------------------------


def next_versions(existing: DataFrame, statements: DataFrame, claim: str, order: str, value: str) -> DataFrame:
    """(claim, value, order, version) to append: statements that change a claim, numbered on from its last version.

    existing: (claim, value, version). A statement that says what the one before it said, or the last version where it is
    the first, makes none; so the same run again, on what it wrote, adds nothing. Null claims are left out; a null value is a
    value. A claim's new statements are ordered in one task.
    """
    last = existing.groupBy(claim).agg(F.max("version").alias("_v"), F.max_by(F.struct(value), "version").alias("_last"))
    rows = statements.filter(F.col(claim).isNotNull()).select(claim, order, value).join(last, claim, "left")
    up = Window.partitionBy(claim).orderBy(order)
    before = F.coalesce(F.lag(F.struct(value)).over(up), F.col("_last"))
    changed = rows.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value)))
    return changed.withColumn("version", (F.coalesce("_v", F.lit(0)) + F.row_number().over(up)).cast("bigint")).select(claim, value, order, "version")


def with_status(versioned: DataFrame, claim: str) -> DataFrame:
    """versioned with status derived from the greatest version of its claim: one aggregation, no window over a claim."""
    last = versioned.groupBy(claim).agg(F.max("version").alias("_max"))
    return versioned.join(last, claim).withColumn("status", F.when(F.col("version") == F.col("_max"), "active").otherwise("superseded")).drop("_max")


def integrity(versioned: DataFrame, claim: str) -> DataFrame:
    """(claim, version, fault) of versions whose stated status isn't the one derived: not_superseded, or not_active; and
    repeated, for a version that a claim has more than once."""
    counted = versioned.groupBy(claim, "version").agg(F.count("*").alias("_n"), F.min("status").alias("status"))
    derived = with_status(counted.withColumnRenamed("status", "_stated"), claim)
    fault = F.when(F.col("_n") > 1, "repeated").when((F.col("_stated") == "active") & (F.col("status") != "active"), "not_superseded").when((F.col("_stated") != "active") & (F.col("status") == "active"), "not_active")
    return derived.select(claim, "version", fault.alias("fault")).filter(F.col("fault").isNotNull())


def read_claims(versioned: DataFrame, evidence: DataFrame, visible: DataFrame, visible_key: str, record: str = "record_id") -> DataFrame:
    """(claim_id, version, n_evidence): the active claims that may be read, as all of their evidence is visible."""
    gate = evidence_gate(evidence, "claim_id", record, visible, visible_key).filter("readable")
    return versioned.filter("status = 'active'").join(gate, "claim_id").select("claim_id", "version", "n_evidence")


def provenance(versioned: DataFrame, evidence: DataFrame, visible: DataFrame, visible_key: str, record: str = "record_id") -> DataFrame:
    """(claim_id, version, record): the evidence of the claims that may be read."""
    return read_claims(versioned, evidence, visible, visible_key, record).select("claim_id", "version").join(evidence.select("claim_id", record), "claim_id").distinct()


def claim_conflicts(members: DataFrame, status: DataFrame, readable: DataFrame, key: str = "conflict_id") -> DataFrame:
    """(claim_id, conflict, status) of the conflicts each claim is in, if all of a conflict's claims may be read."""
    shown = mask_conflicts(members, readable, key).filter("readable").select(key)
    return members.select("claim_id", key).distinct().join(shown, key, "left_semi").join(status, key).select("claim_id", key, "status")


def annotate_conflicts(records: DataFrame, record: str, evidence: DataFrame, conflicts: DataFrame, key: str = "conflict_id") -> DataFrame:
    """(record, conflict, status, n_claims) of the conflicts that a record's claims are in; conflicts as claim_conflicts gives."""
    joined = records.select(record).join(evidence.select(record, "claim_id").distinct(), record).join(conflicts, "claim_id")
    return joined.groupBy(record, key, "status").agg(F.count_distinct("claim_id").alias("n_claims"))


def decision_targets(decisions: DataFrame, versioned: DataFrame, target: str = "target") -> DataFrame:
    """decisions with target_version and target_status of the claim each names; null where it names none or an unknown one."""
    claims = versioned.groupBy("claim_id").agg(F.max("version").alias("target_version"), F.max_by("status", "version").alias("target_status"))
    return decisions.join(claims, F.col(target) == F.col("claim_id"), "left").drop("claim_id")


def duplicate_hashes(rows: DataFrame, hashed: str) -> DataFrame:
    """(hash, n) of hashes that several rows have; null hashes don't count."""
    return rows.filter(F.col(hashed).isNotNull()).groupBy(hashed).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_counters(rows: DataFrame, hashed: str) -> DataFrame:
    """One row: n_hashes repeated, and n_rows beyond the first of each."""
    return duplicate_hashes(rows, hashed).agg(F.count("*").alias("n_hashes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_rows"))
