"""Encoding whole texts with a public byte-level BPE vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern and each pre-token is merged with a rank queue: a hierarchical
bitmap holds one bit per merge rank that waits, find-first-set gives the lowest one, and the bucket of that rank holds the
positions of its pairs in a linked list of symbols. Merging a pair makes entries of its neighbours stale; they are skipped
when their turn comes. A pre-token of n bytes takes O(n) bucket entries whatever its length. Pieces between spaces are
remembered with their ids, as corpora repeat most of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.tables import spread

#: The pre-token pattern of the vocabulary, and white space as that pattern means it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the public vocabularies are; a parameter, they are never copied.
TOKENIZERS = "/opt/tokenizers"
#: Pieces that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
_FANOUT = 62


class RankQueue:
    """Merge ranks that wait, lowest first: three levels of 62-bit words over the ranks."""

    def __init__(self, ranks: int):
        self.levels = []
        size = ranks
        while True:
            size = -(-size // _FANOUT)
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        at = rank
        for level in self.levels:
            at, bit = divmod(at, _FANOUT)
            before = level[at]
            level[at] = before | 1 << bit
            if before:
                break

    def pop(self):
        """The entries of the lowest waiting rank, or None."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at * _FANOUT + (word & -word).bit_length() - 1
        entries = self.buckets.pop(at)
        place = at
        for level in self.levels:
            place, bit = divmod(place, _FANOUT)
            level[place] &= ~(1 << bit)
            if level[place]:
                break
        return at, entries


class BytePairEncoder:
    """Ids of texts by ranked byte-pair merges; what looks like a special token is plain text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = max(self.ids.values()) + 1
        self.pretokens = regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")).findall
        self.pieces = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.queue = RankQueue(self.ranks)
        self.known: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = self.ids
        whole = ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        start, end = list(range(n)), list(range(1, n + 1))
        following, before = list(range(1, n)) + [-1], [-1] + list(range(n - 1))
        alive, queue = [True] * n, self.queue

        def offer(left: int) -> None:
            right = following[left]
            if right >= 0:
                rank = ids.get(data[start[left] : end[right]])
                if rank is not None:
                    queue.push(rank, (left, right, end[right]))

        for i in range(n - 1):
            offer(i)
        while (got := queue.pop()) is not None:
            rank, entries = got
            for left, right, stop in sorted(entries):
                if not (alive[left] and alive[right]) or following[left] != right or end[right] != stop or ids.get(data[start[left] : stop]) != rank:
                    continue
                end[left], alive[right] = stop, False
                after = following[left] = following[right]
                if after >= 0:
                    before[after] = left
                offer(left)
                if before[left] >= 0:
                    offer(before[left])
        out, at = [], 0
        while at >= 0:
            out.append(ids[data[start[at] : end[at]]])
            at = following[at]
        return out

    def piece(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.pretokens(text):
            out += self.merge(token.encode("utf-8", "replace"))
        return out

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts give an empty list."""
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text or ""):
            got = known.get(piece)
            if got is None:
                got = self.piece(piece)
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            out += got
        return out


def token_ids(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of every row, by a narrow map over Arrow batches: no shuffle, texts of any length whole.

    Null and empty texts give an empty list; rows that repeat a key are kept as they are; extra columns are ignored.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = BytePairEncoder(vocabulary)
        for batch in batches:
            yield batch.map(encoder.encode)

    return spread(documents.select(key, text)).select(key, ids(text).alias("ids"))
