"""Token counts by a public tokenizer's vocabulary file, per Arrow batch. The file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default vocabulary; every executor must see the same path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the rank files, which splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The encoder of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(path: str = VOCABULARY) -> np.ndarray:
    """Bytes of each token id."""
    enc = encoding(path)
    sizes = np.zeros(enc.n_vocab, dtype=np.int64)
    for token in enc.token_byte_values():
        sizes[enc.encode_single_token(token)] = len(token)
    return sizes


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text; null for null, 0 for empty."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return texts.map(lambda t: None if t is None else len(enc.encode_ordinary(t))).astype("Int64")

    return count(text)
