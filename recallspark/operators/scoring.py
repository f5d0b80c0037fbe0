"""Exact vector similarity and the weighted recall of the older path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one is null or of length 0 (norm 0)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, block: int = 16384) -> DataFrame:
    """(query, key, similarity, rank): exact top k by cosine, rounded to six digits; ties go to the smaller key.

    Neither side is collected or broadcast: both are cut into blocks of about `block` rows, each pair of blocks is one
    matrix product, and only k rows per query and block go on to the last ranking. Keys are bigints. Null vectors and
    vectors of norm 0 match nothing; vectors of another length than the first of their block fail.
    """
    rows, asked = vectors.count(), queries.count()
    if not rows or not asked:
        return vectors.sparkSession.createDataFrame([], "query bigint, key bigint, similarity double, rank int")
    v_blocks, q_blocks = -(-rows // block), -(-asked // block)
    left = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(v_blocks)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    right = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("query"), F.col(query_vector).alias("v"), F.pmod(F.xxhash64(query_key), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"))

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if not len(rows) or not len(asked):
            return empty
        rows = rows.sort_values("key")
        v, q = (np.array(side["v"].tolist(), dtype=np.float64) for side in (rows, asked))
        v_norm, q_norm = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
        keys, names, out = rows["key"].to_numpy(), asked["query"].to_numpy(), []
        for at in range(0, len(q), 512):
            part = slice(at, at + 512)
            with np.errstate(invalid="ignore", divide="ignore"):
                similar = np.round(q[part] @ v.T / (q_norm[part, None] * v_norm[None, :]), 6)
            similar[~np.isfinite(similar)] = -np.inf
            for name, line in zip(names[part], similar):
                least = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                near = np.flatnonzero((line >= least) & (line > -np.inf))
                near = near[np.lexsort((keys[near], -line[near]))][:k]
                out.append(pd.DataFrame({"query": name, "key": keys[near], "similarity": line[near]}))
        return pd.concat(out, ignore_index=True) if out else empty

    each = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(best, "query bigint, key bigint, similarity double")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key"))).filter(F.col("rank") <= k)


def latest_vectors(vectors: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert semantics: the last row of each key."""
    return vectors.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")


def decay(days: Column, valence: Column, arousal: Column) -> Column:
    half = F.when(F.greatest(F.lit(0.0), (valence + 1) / 2) * arousal >= 0.5, 30.0).otherwise(7.0)
    return F.pow(F.lit(0.5), days / half)


def recall_weight(similarity: Column, valence: Column, arousal: Column, days: Column, in_saga: Column, done: Column, digits: int = 4) -> Column:
    """0.35 similarity, 0.25 evenness, 0.20 decay, 0.20 saga, and 0.3 if undone."""
    even = F.greatest(F.lit(0.0), 1 - F.abs(valence))
    value = 0.35 * F.coalesce(similarity, F.lit(0.5)) + 0.25 * even + 0.20 * decay(days, valence, arousal) + 0.20 * F.when(in_saga, 1.5).otherwise(1.0) + F.when(done, 0.0).otherwise(0.3)
    return F.round(value, digits)


def active_weight(undone: Column, valence: Column, arousal: Column, recalls: Column) -> Column:
    return 0.6 * undone.cast("double") + 0.3 * valence * valence * arousal + 0.1 * (1 - F.least(recalls / 10, F.lit(1.0)))


def rolling_factor(rows: DataFrame, by: str, order: list[str], value: str, last: int = 10) -> DataFrame:
    """(by, factor): 1 + 0.2 x mean of the newest `last` values; nulls count as rows, not as values."""
    newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("_n") <= last)
    return newest.groupBy(by).agg((1 + 0.2 * F.coalesce(F.avg(value), F.lit(0.0))).alias("factor"))


def sessions(rows: DataFrame, by: str, at: str, key: str, gap_minutes: int = 45) -> DataFrame:
    """rows with session, counted from 1: a new one begins after a silence of at least gap_minutes."""
    order = Window.partitionBy(by).orderBy(at, key)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    opens = F.coalesce((micros - F.lag(micros).over(order) >= gap_minutes * 60_000_000).cast("int"), F.lit(1))
    return rows.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


# Scalars of the older path ---------------------------------------------------------------------------------------------------

#: What a word adds to importance, and words that raise or lower toxicity, in order.
IMPORTANCE = {"保长": 0.2, "master": 0.2, "催": 0.2, "哭": 0.3, "难过": 0.3}
TOXIC = ("滚", "嘴臭", "瓜娃子", "臭", "烦", "讨厌", "蠢")
SWEET = ("亲", "爱", "乖", "棒", "厉害", "谢谢", "好棒")
#: Minutes between pushes and pushes a day, by trigger level.
LEVELS = {"L1": (60, 5), "L2": (120, 3), "L3": (30, 2)}


def importance(text: Column, words: dict[str, float] = IMPORTANCE) -> Column:
    """0.5 and what each word found adds, at most 1; 0.5 for null."""
    added = sum((F.when(F.contains(text, F.lit(w)), boost).otherwise(0.0) for w, boost in words.items()), F.lit(0.5))
    return F.round(F.least(added, F.lit(1.0)), 6)


def toxicity(text: Column, toxic: tuple[str, ...] = TOXIC, sweet: tuple[str, ...] = SWEET) -> Column:
    """0.2 for each toxic word found, then 0.1 less for each sweet one but never below 0, at most 1; 0 for null."""
    score = sum((F.when(F.contains(text, F.lit(w)), 0.2).otherwise(0.0) for w in toxic), F.lit(0.0))
    # The floor at 0 after each step is the floor of the whole, as every step goes down.
    less = sum((F.when(F.contains(text, F.lit(w)), 0.1).otherwise(0.0) for w in sweet), F.lit(0.0))
    return F.round(F.least(F.greatest(score - less, F.lit(0.0)), F.lit(1.0)), 6)


def push_interval(conscientiousness: Column) -> Column:
    """Minutes: 15 below 0.3, 120 above 0.7, else 60; 60 for null."""
    return F.when(conscientiousness < 0.3, 15).when(conscientiousness > 0.7, 120).otherwise(60)


def trigger_level(urgent: Column, in_saga: Column) -> Column:
    return F.when(urgent, "L3").when(in_saga, "L2").otherwise("L1")


def falsy_default(value: Column, default: float) -> Column:
    """The value, or the default where it is null or zero: the older path takes zero for nothing."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def persona_update(warmth: Column, directness: Column, stress: Column) -> tuple[Column, Column]:
    """Under stress above 0.7 warmth grows and directness falls by 0.1; both stay within 0 and 1."""
    clamp = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 6)
    tense = F.when(stress > 0.7, 0.1).otherwise(0.0)
    return clamp(warmth + tense), clamp(directness - tense)


def user_state(actions: DataFrame, by: str, at: str, action: str, states: dict[str, tuple[str, int]], now: Column) -> DataFrame:
    """(by, state): of each one's last action the first keyword in it that has a state whose expected minutes, half as many
    again, haven't passed; null else. states: keyword -> (state, minutes), in order."""
    last = actions.groupBy(by).agg(F.max_by(F.struct(F.col(at).alias("at"), F.col(action).alias("what")), at).alias("l"))
    minutes = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("l.at").cast("timestamp"))) / 60_000_000
    state = F.coalesce(*[F.when(F.contains("l.what", F.lit(word)) & (minutes < 1.5 * expected), name) for word, (name, expected) in states.items()])
    return last.select(by, state.alias("state"))


def opposite_pairs(rows: DataFrame, by: str, key: str, valence: str, least: float = 0.3, most: int = 2) -> DataFrame:
    """(by, key, other, group_id): each strongly felt row with the first `most` rows before it, by key, of the opposite sign.

    What came before is looked up by place among the rows of the other sign, so that a group is joined on places and never
    paired as a whole. Rows within `least` of zero, and null ones, take no part.
    """
    felt = rows.filter(F.abs(F.col(valence)) > least).select(by, key, (F.col(valence) > 0).alias("up"))
    placed = felt.withColumn("n", F.row_number().over(Window.partitionBy(by, "up").orderBy(key))).filter(F.col("n") <= most)
    firsts = placed.select(by, F.col(key).alias("other"), (~F.col("up")).alias("up"))
    pairs = felt.join(firsts, [by, "up"]).filter(F.col("other") < F.col(key))
    return pairs.select(by, key, "other", F.substring(F.sha2(F.concat_ws("|", F.col(by).cast("string"), F.col(key).cast("string")), 256), 1, 8).alias("group_id"))


def active_rank(rows: DataFrame, by: str, key: str, weight: str, limit: int) -> DataFrame:
    """The `limit` rows of greatest weight for each `by`, with rank; ties go to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.col(weight).desc(), F.col(key).asc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fixed_embedding(text: Column, size: int = 1536) -> Column:
    """The stand-in embedding: every component 0.1, so that all distances are 0; null for null."""
    return F.when(text.isNotNull(), F.array_repeat(F.lit(0.1), size))
