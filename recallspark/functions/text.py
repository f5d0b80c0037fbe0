"""The three case rules, phrases and grams. Which one an operator uses is part of its meaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(text: Column) -> Column:
    """ASCII case only, as LIKE of the embedded store folds it; É stays É."""
    return F.translate(text, _UPPER, _LOWER)


def like_contains(text: Column, term: str) -> Column:
    """Substring match, ASCII case folded. The term is literal: no wildcard has a meaning."""
    return F.contains(ascii_fold(text), F.lit(term.translate(str.maketrans(_UPPER, _LOWER))))


def phrase_contains(text: Column, phrase: str) -> Column:
    """Phrase of consecutive trigrams: Unicode case folded; phrases below three characters match nothing."""
    return F.contains(F.lower(text), F.lit(phrase.lower())) if len(phrase) >= 3 else F.lit(False)


def grams(text: Column, n: int = 3) -> Column:
    """Overlapping character n-grams of the lower-cased text; empty for shorter ones."""
    low = F.lower(text)
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def phrase_count(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of a phrase, case folded."""
    literal = phrase.lower().replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_count(F.lower(text), F.lit(f"(?=\\Q{literal}\\E)"))


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def distinct_alnum(text: Column) -> Column:
    """Number of different letters and digits, case folded."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    return F.when(kept == "", 0).otherwise(F.size(F.array_distinct(F.split(kept, ""))))


def nfkc(text: Column) -> Column:
    """NFKC with whitespace collapsed; Spark has no built-in. Apply it once on the way in, not per query."""

    @F.pandas_udf(T.StringType())
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))

    return fold(text)


def reference(scheme: str, path: Column, **parameters: Column) -> Column:
    """scheme://path?name=value&...: values percent-encoded; null parameters are left out."""
    pairs = [F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string"))) for name, value in parameters.items()]
    return F.concat(F.lit(f"{scheme}://"), path, F.when(F.coalesce(*pairs).isNotNull(), F.concat(F.lit("?"), F.concat_ws("&", *pairs))).otherwise(""))


def query_value(url: Column, name: str) -> Column:
    """A query parameter of a reference, percent-decoded; null where it has none or isn't a URL."""
    return F.url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit("")))
