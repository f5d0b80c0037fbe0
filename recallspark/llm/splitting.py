"""Oversized texts to pieces at natural boundaries: a structure tree, packed bottom-up.

A text is read as a tree: headings by level, then blocks parted by blank lines (a fenced block is one), then lines (list
items, speaker turns), sentences, clauses and words. A node that fits is one unit; only an oversized node is opened, and
sibling units are merged while they fit. What has no boundary at all, such as a long unbroken run, is cut between tokens.
Each piece but the first begins with the last `overlap` tokens before its cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.tokens import VOCABULARY, encoding, token_lengths

_FENCE = re.compile(r"^ {0,3}(```|~~~)", re.M)
_HEADING = [re.compile(rf"^ {{0,3}}#{{{level}}}(?=\s)", re.M) for level in range(1, 7)]
#: After headings, coarse to fine: each pattern's matches end a unit.
_BREAKS = [
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*"),
    re.compile(r"[;:,]\s+|[；：，、]"),
    re.compile(r"\s+"),
]


class _Text:
    """Token positions of one text, for counting the tokens of any span without encoding it again."""

    def __init__(self, text: str, path: str) -> None:
        self.text, self.path = text, path
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)
        self.byte_at = np.concatenate(([0], np.cumsum(width)))
        ids = encoding(path).encode_ordinary(text)
        ends = np.cumsum(token_lengths(path)[np.asarray(ids, dtype=np.int64)]) if ids else np.zeros(0, dtype=np.int64)
        self.ends = ends.tolist()
        self.total = len(ids)
        fences = [m.start() for m in _FENCE.finditer(text)]
        self.fenced = list(zip(fences[0::2], fences[1::2] + [len(text)] * (len(fences) % 2)))

    def token(self, char: int) -> int:
        """Tokens that end at or before a character's start."""
        return bisect_right(self.ends, int(self.byte_at[char]))

    def size(self, a: int, b: int) -> int:
        """An upper bound of the tokens that touch characters a to b."""
        return bisect_left(self.ends, int(self.byte_at[b])) + 1 - self.token(a) if b > a else 0

    def char(self, token: int) -> int:
        """The first character that begins at or after the end of `token` tokens."""
        return int(np.searchsorted(self.byte_at, self.ends[token - 1] if token else 0, side="left"))

    def in_fence(self, char: int) -> bool:
        k = bisect_right(self.fenced, (char, 1 << 60)) - 1
        return k >= 0 and self.fenced[k][0] < char < self.fenced[k][1]


def _children(t: _Text, a: int, b: int, level: int) -> list[tuple[int, int]]:
    """The parts of a span at one level of the tree; they cover it without gaps."""
    if level < len(_HEADING):
        cuts = [m.start() for m in _HEADING[level].finditer(t.text, a, b) if not t.in_fence(m.start())]
    else:
        cuts = [m.end() for m in _BREAKS[level - len(_HEADING)].finditer(t.text, a, b)]
        if level == len(_HEADING):
            cuts = [c for c in cuts if not t.in_fence(c)]
    edges = [a, *(c for c in cuts if a < c < b), b]
    return list(zip(edges, edges[1:]))


def _pack(t: _Text, a: int, b: int, level: int, room: int) -> list[tuple[int, int]]:
    """Spans of at most `room` tokens that cover a to b."""
    stack: list[tuple[int, int]] = []
    if t.size(a, b) <= room:
        return [(a, b)]
    if level == len(_HEADING) + len(_BREAKS):
        while t.size(a, b) > room:
            cut = min(b, max(a + 1, t.char(t.token(a) + room - 2)))
            stack.append((a, cut))
            a = cut
        return [*stack, (a, b)] if b > a else stack
    # Siblings that fit are merged; the parts of one that was opened stay apart from the siblings around it.
    whole = False
    for c, d in _children(t, a, b, level):
        if t.size(c, d) > room:
            stack += _pack(t, c, d, level + 1, room)
            whole = False
        elif whole and t.size(stack[-1][0], d) <= room:
            stack[-1] = (stack[-1][0], d)
        else:
            stack.append((c, d))
            whole = True
    return stack


def split_text(text: str, limit: int = 2048, overlap: int = 64, path: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(start, begin, end, tokens) of each piece text[start:end]; text[start:begin] is the overlap with the piece before.

    A text of at most `limit` tokens is one piece. The parts text[begin:end] give the text back, joined in order. No piece
    has more than `limit` tokens by its own encoding.
    """
    if overlap * 2 >= limit:
        raise ValueError("the overlap must be less than half the limit")
    t = _Text(text, path)
    if t.total <= limit:
        return [(0, 0, len(text), t.total)]
    enc = encoding(path)
    out = []
    # Encoding a piece by itself can differ by a few tokens at its ends; such a piece is packed again with less room.
    todo = [(a, b, limit - overlap - 8) for a, b in reversed(_pack(t, 0, len(text), 0, limit - overlap - 8))]
    while todo:
        a, b, room = todo.pop()
        start = max(0, min(a, t.char(max(0, t.token(a) - overlap)))) if out else a
        n = len(enc.encode_ordinary(text[start:b]))
        if n > limit and b - a > 1:
            smaller = max(1, room * 3 // 4)
            todo += [(c, d, smaller) for c, d in reversed(_pack(t, a, b, 0, smaller))]
            continue
        out.append((start, a, b, n))
    return out


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048, overlap: int = 64, path: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """(doc_id, piece_no, start_char, begin_char, end_char, n_tokens[, piece]) of every text of more than `limit` tokens.

    Texts of at most `limit` UTF-8 bytes can't have more tokens, and leave before Python sees them. One narrow pass; null
    and empty texts and null keys give no rows; other columns aren't carried, they join by the key.
    """
    schema = "doc_id bigint, piece_no int, start_char int, begin_char int, end_char int, n_tokens int" + (", piece string" if with_text else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch["k"], batch["t"]):
                spans = split_text(value, limit, overlap, path)
                if len(spans) > 1:
                    rows += [(doc_id, no, s, a, b, n, value[s:b])[: len(columns)] for no, (s, a, b, n) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=columns)

    large = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & (F.octet_length("t") > limit))
    return large.mapInPandas(cut, schema)


def found(documents: DataFrame) -> DataFrame:
    """Every document of more than 2,048 tokens, as one that was cut."""
    return pieces(documents, with_text=False).filter(F.col("piece_no") == 1).select("doc_id")
