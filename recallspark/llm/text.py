"""Words, canonical contents and fingerprints shared by the text operators, as Catalyst expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.functions.binding import let

#: Also Unicode whitespace.
BLANK = r"^[\s\p{Z}\x{85}\x{1C}-\x{1F}]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
_MOD = (1 << 61) - 1
_WORDS = re.compile(r"[^\W_]+")


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but whitespace."""
    return text.isNull() | text.rlike(BLANK)


def fold(text: Column) -> Column:
    """Without case; ß meets SS. Catalyst would drop an upper() below lower(), so that ß is named here."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def word_text(text: Column) -> Column:
    """The words, maximal runs of letters and digits without case, parted by one blank."""
    return F.trim(F.regexp_replace(fold(text), NOT_WORD, " "))


def list_pairs(text: Column) -> Column:
    """name\\x01value pairs of a list of three or more fields, one per line or parted by ';'; else null."""
    parts = F.filter(F.split(text, r"[;\r\n]+"), lambda x: ~is_blank(x))

    def pairs(p: Column) -> Column:
        named = (F.size(p) >= 3) & F.forall(p, lambda x: F.regexp_extract(x, r"^([^:=]*)[:=]", 1).rlike(r"[\p{L}\p{N}]"))
        return F.when(named, F.transform(p, lambda x: F.concat(word_text(F.regexp_extract(x, r"^([^:=]+)[:=]", 1)), F.lit("\x01"), word_text(F.regexp_replace(x, r"^[^:=]+[:=]", "")))))

    return F.when(text.rlike("[:=]") & text.rlike(r"[;\r\n]"), let(parts, pairs))


def multiset_hash(items: Column, seed: int) -> Column:
    """Sum of the items' hashes modulo 2^61 - 1: the same for any order, and repeated items count."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda total, x: (total + F.xxhash64(F.lit(seed), x).bitwiseAND(F.lit(_MOD))) % F.lit(_MOD))


def _flatten(value: object, path: str) -> Iterator[str]:
    if isinstance(value, list) and value:
        for k, inner in enumerate(value):
            yield from _flatten(inner, f"{path}\x02[{k}]")
    elif isinstance(value, _Object) and value.items:
        for name, inner in value.items:
            yield from _flatten(inner, f"{path}\x02{_words(name)}")
    else:
        text = {True: "true", False: "false", None: "null"}.get(value, value) if isinstance(value, (bool, type(None))) else value
        mark = "\x03{}" if isinstance(value, _Object) else "\x03[]" if isinstance(value, list) else _words(str(text))
        yield f"{path}\x01{mark}"


class _Object:
    def __init__(self, items: list[tuple[str, object]]) -> None:
        self.items = items


def _words(text: str) -> str:
    return " ".join(_WORDS.findall(text.upper().lower()))


def _json_pairs(text: str) -> list[str] | None:
    """path\\x01value for each leaf of a JSON object, names and values by words; None if it isn't one."""
    try:
        value = json.loads(text, object_pairs_hook=_Object, parse_float=str, parse_int=str)
    except (ValueError, RecursionError):
        return None
    return list(_flatten(value, "")) if isinstance(value, _Object) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _json_pairs_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_json_pairs)


def content_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, h1, h2, pairs) of each content that isn't blank: kind 'words' always, 'json' or 'list' where it is one.

    Two contents are equal if they share a kind and its pairs as a multiset. h1 and h2 are independent commutative
    hashes of the pairs. Only texts that begin with a brace go through Python.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & ~is_blank(F.col("text")))
    words = rows.select("key", F.lit("words").alias("kind"), F.array(word_text(F.col("text"))).alias("pairs"))
    braced = F.col("text").rlike(r"^\s*\{")
    listed = rows.filter(~braced).select("key", F.lit("list").alias("kind"), list_pairs(F.col("text")).alias("pairs"))
    parsed = rows.filter(braced).select("key", F.lit("json").alias("kind"), _json_pairs_udf(F.col("text")).alias("pairs"))
    fields = listed.unionByName(parsed).filter(F.col("pairs").isNotNull())
    return words.unionByName(fields).select("key", "kind", multiset_hash(F.col("pairs"), 1).alias("h1"), multiset_hash(F.col("pairs"), 2).alias("h2"), "pairs")


def same_pairs(a: Column, b: Column) -> Column:
    """Field by field, without sorting. Different counts of one repeated pair differ in the hashes already."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
