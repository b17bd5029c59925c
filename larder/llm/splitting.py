"""Splitting oversized items at natural boundaries.

Balanced targets: the least number of pieces is computed from the limit, equal-length targets are placed, each is snapped
to the strongest boundary nearby, and a piece is added when any piece misses the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.tables import code_points

#: Code points of an item with its metadata, and of what consecutive pieces share.
LIMIT, OVERLAP = 2400, 200
#: Boundaries from the strongest to the weakest; a cut falls behind the match.
BOUNDARIES = tuple(
    re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n(?=\||#|[-*•]\s|\d+[.)]\s)|(?<=\|)\n", r"\n", r"[.!?…][\"”“»)\]]*\s+", r"[;:]\s+|,\s+", r"\s+")
)
#: Share of a piece's length by which a cut may leave its target for a boundary.
REACH = 0.35
#: Numbers of pieces that are tried to find boundaries for all cuts.
TRIES = 5


def cut_points(text: str, room: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces: each at most ``room`` long, each but the first starting ``overlap`` before the end
    of the one before. ``room`` must exceed the overlap; a text gives at most its length divided by ``room - overlap``
    pieces more than that takes.

    With the least number of pieces every cut has a window in which the rest still fits; where a window holds no boundary,
    a few numbers above are tried, and the one with the fewest cuts off boundaries is taken.
    """
    n = len(text)
    if n <= room:
        return [(0, n)]
    places = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    least = max(2, -(-(n - overlap) // (room - overlap)))
    best: tuple[int, list[int]] | None = None
    for pieces in dict.fromkeys((least, *(min(least + max(1, least * k // 20), n - overlap) for k in range(1, TRIES)))):
        if pieces < least:
            continue
        off, ends = _snap(places, n, pieces, room, overlap)
        if best is None or off < best[0]:
            best = off, ends
        if not off:
            break
    starts = [0] + [e - overlap for e in best[1][:-1]]
    return list(zip(starts, best[1]))


def _snap(places: list[list[int]], n: int, pieces: int, room: int, overlap: int) -> tuple[int, list[int]]:
    """Ends of the pieces, and how many of them are at no boundary. A cut lies where its piece keeps the room and the rest
    fits into the pieces behind it."""
    length, step = (n - overlap) / pieces, room - overlap
    ends, last, off = [], overlap, 0
    for i in range(1, pieces):
        low = max(last + 1, n - (pieces - i) * step)
        high = min(last + step, n - (pieces - i))
        target = min(max(round(overlap + length * i), low), high)
        reach = max(1, int(REACH * length))
        end = None
        for kind in places:
            a, b = bisect_left(kind, max(low, target - reach)), bisect_right(kind, min(high, target + reach))
            if a < b:
                near = bisect_left(kind, target, a, b)
                end = min(kind[max(a, near - 1) : min(b, near + 1)], key=lambda p: (abs(p - target), p))
                break
        off += end is None
        last = target if end is None else end
        ends.append(last)
    return off, ends + [n]


def pieces_of(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, piece_no, pieces, start, end, text, metadata`` of every item whose size exceeds ``limit``.

    The size is the code points of the text and of folder, doc_type and source, null as 0; null text is no case. Every
    piece carries the metadata and keeps the limit with it; where the metadata alone leaves no room for the overlap and one
    more code point, the room is twice the overlap, which is reported by ``over_limit``. Only oversized items leave the
    JVM; re-delivered items count once. Texts are cut whole, however long.
    """
    meta = sum((code_points(F.col(f"metadata.{c}")) for c in ("folder", "doc_type", "source")), F.lit(0))
    version = F.xxhash64("text", "metadata.folder", "metadata.doc_type", "metadata.source")
    large = items.select("chunk_id", "text", "metadata", meta.alias("meta_size"), version.alias("version")).where(F.length("text") + F.col("meta_size") > limit)
    schema = "chunk_id bigint, piece_no int, pieces int, start int, end int, text string, over_limit boolean, metadata struct<folder string, doc_type string, source string>, version bigint"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk_id, text, metadata, size, version in zip(*(batch[c] for c in ("chunk_id", "text", "metadata", "meta_size", "version"))):
                room = int(limit - size)
                over = room <= overlap
                spans = cut_points(text, 2 * overlap if over else room, overlap)
                rows += [(chunk_id, i, len(spans), a, b, text[a:b], over, metadata, version) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "pieces", "start", "end", "text", "over_limit", "metadata", "version"])

    parts = large.mapInPandas(cut, schema)
    # an item that was delivered with different texts gives the pieces of one of them only
    first = F.min("version").over(Window.partitionBy("chunk_id"))
    return parts.withColumn("first", first).where("version = first").drop("first", "version").dropDuplicates(["chunk_id", "piece_no"])
