"""Evaluation passages in training text: a broadcast hash set of normalised n-grams, whole texts scanned window by window.

Everything but letters and digits is ignored, without case, so that the tokens of a window are characters. A shared run of
`least` characters holds, at any offset, a whole n-gram that begins at a multiple of the stride, if n + stride - 1 <= least;
so the set needs only those n-grams of the items. Every window of a text is tested by a rolling hash, computed for many
texts at once; a hit is verified character by character and extended both ways until the texts differ.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least shared run in letters and digits, by language of the item.
LEAST = {"zh": 24}
LEAST_ELSE = 60
#: Characters of items in one block. A block is what the driver gathers and broadcasts; more items make more blocks, each
#: with a scan of its own.
BLOCK_CHARS = 50_000_000
#: Characters of texts that are hashed at once.
SCAN_CHARS = 1 << 19
_DROP = re.compile(r"[\W_]+")
#: The base of the rolling hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def normal(text: str) -> str:
    return _DROP.sub("", text.upper().lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _windows(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of n characters."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(len(codes) - 1, base, dtype=np.uint64))), dtype=np.uint64) for base in (_BASE, _INVERSE))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * powers, dtype=np.uint64)))
    # Without the last factor the upper bits would hardly depend on a window's last characters.
    mixed = (sums[n:] - sums[:-n]) * inverse[: len(codes) - n + 1]
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Passages:
    """The hash set of the items' n-grams."""

    def __init__(self, items: list[tuple[int, str, int]]) -> None:
        """items: (item_id, normalised text, least run)."""
        self.items = [(i, t, n) for i, t, n in items if len(t) >= n]
        parts: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for k, (_, text, least) in enumerate(self.items):
            n = (least + 1) // 2
            at = np.arange(0, len(text) - n + 1, least - n + 1)
            parts.setdefault(n, []).append((_windows(_codes(text), n)[at], k, at))
        #: By length of the n-grams: their hashes in order, with item and place, and a bitmap of the hashes' upper bits.
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = {}
        for n, found in parts.items():
            hashes = np.concatenate([h for h, _, _ in found])
            owner = np.concatenate([np.full(len(h), k) for h, k, _ in found])
            place = np.concatenate([at for _, _, at in found])
            order = np.argsort(hashes, kind="stable")
            bits = max(16, min(26, int(len(hashes)).bit_length() + 4))
            bitmap = np.zeros(1 << bits, dtype=bool)
            bitmap[hashes >> np.uint64(64 - bits)] = True
            self.sets[n] = hashes[order], owner[order], place[order], bitmap, bits

    def scan(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """item_id -> verified runs (start, end) in the normalised text."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str]) -> list[dict[int, list[tuple[int, int]]]]:
        out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
        first = 0
        while first < len(texts):
            until, size = first + 1, len(texts[first])
            while until < len(texts) and size + len(texts[until]) <= SCAN_CHARS:
                size, until = size + len(texts[until]), until + 1
            self._scan(texts[first:until], out[first:until])
            first = until
        return out

    def _scan(self, texts: list[str], out: list[dict[int, list[tuple[int, int]]]]) -> None:
        codes = _codes("\n".join(texts))  # no normalised text holds the line end, so that no n-gram spans two texts
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).tolist()
        covered: dict[tuple[int, int, int], int] = {}
        for n, (hashes, owner, place, bitmap, bits) in self.sets.items():
            seen = _windows(codes, n)
            hit = np.flatnonzero(bitmap[seen >> np.uint64(64 - bits)])
            low, high = (np.searchsorted(hashes, seen[hit], side) for side in ("left", "right"))
            for at, a, b in zip(hit[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                doc = bisect_right(begins, at) - 1
                start, text = at - begins[doc], texts[doc]
                for g in range(a, b):
                    k, begin = int(owner[g]), int(place[g])
                    if covered.get((doc, k, start - begin), -1) <= start:
                        self._verify(text, start, k, begin, n, out[doc], covered, doc)

    def _verify(self, text: str, start: int, k: int, begin: int, n: int, found: dict, covered: dict, doc: int) -> None:
        item_id, item, least = self.items[k]
        if text[start : start + n] != item[begin : begin + n]:
            return
        a, b, c, d = start, begin, start + n, begin + n
        while a > 0 and b > 0 and text[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        while c < len(text) and d < len(item) and text[c] == item[d]:
            c, d = c + 1, d + 1
        covered[doc, k, start - begin] = c
        if c - a >= least:
            found.setdefault(item_id, []).append((a, c))


def _blocks(items: DataFrame, block_chars: int) -> Iterator[Passages]:
    """The items' sets, block by block; an item is in one block, by the hash of its id."""
    rows = items.select("item_id", "lang", "item_text").filter(F.col("item_text").isNotNull() & F.col("item_id").isNotNull())
    size = rows.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        yield Passages([(r.item_id, normal(r.item_text), LEAST.get(r.lang, LEAST_ELSE)) for r in part])


def hits(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_runs, longest): every document that shares a long enough run with an item.

    One narrow pass over the documents per block of items (about block_chars characters), nothing is shuffled; so items may
    be of any number. Null and blank texts match nothing, null ids are left out; copies of a document are reported each; items
    that share a passage are all reported.
    """
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out = None
    for passages in _blocks(items, block_chars):
        part = _scan_block(texts, documents.sparkSession.sparkContext.broadcast(passages))
        out = part if out is None else out.unionByName(part)
    return out


def _scan_block(texts: DataFrame, held) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"], held.value.scan_all([normal(t) for t in batch["text"]])):
                rows += [(doc_id, item_id, len(set(runs)), max(c - a for a, c in runs)) for item_id, runs in found.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_runs", "longest"]).astype({"doc_id": "int64", "item_id": "int64", "n_runs": "int32", "longest": "int32"})

    return texts.mapInPandas(scan, "doc_id bigint, item_id bigint, n_runs int, longest int")


def clean(documents: DataFrame, items: DataFrame, mask: str = "", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents with each leaked span replaced by mask. Rows, order of columns and all other columns stay. The blocks of
    items are all searched in the text as it came, so that no span is missed for another one's removal."""
    held = [documents.sparkSession.sparkContext.broadcast(passages) for passages in _blocks(items, block_chars)]

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _cut([h.value for h in held], t, mask) if t else t)

    return documents.withColumn("text", F.pandas_udf(cut, "string")(F.col("text")))


def _cut(blocks: list[Passages], text: str, mask: str) -> str:
    chars, places = [], []
    for k, ch in enumerate(text):
        for c in normal(ch):
            chars.append(c)
            places.append(k)
    spans = sorted(span for passages in blocks for runs in passages.scan("".join(chars)).values() for span in runs)
    out, at = [], 0
    for a, c in spans:
        first, last = places[a], places[c - 1] + 1
        if last <= at:
            continue
        out.append(text[at : max(at, first)] + mask)
        at = last
    return "".join(out) + text[at:]


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return hits(documents, items).select("doc_id", "item_id").distinct()
