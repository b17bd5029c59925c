"""Page furniture around the main content of web pages.

Method: consensus host paths. The chunks hold rendered lines, not tags, so a page's containers are its runs of lines of one
sort (running text with the title above it, list items, links), and the path of a line is the kind of line with its
generalised text (numbers as ``#``, case and spacing levelled; a row of links is one path per link). Each page scores its
containers by their share of running text, and every line votes, in Spark, for its path with the score of its container. A
path wins on a host if it recurs on a share of the host's pages that rises with the score: what stands among links needs few
pages, what stands in running text needs more. Paths that recur over hosts win everywhere. Every page is then read again
with the winning paths: a line on one is furniture, and so are rows made of winning parts and the links under a winning
label, to the end of their container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import staged
from larder.llm.words import hash64, mix

#: Share of a host's pages on which a path must occur to win there, among links and in running text, and least pages;
#: share of all pages and least hosts; a path that wins on that many hosts wins on all.
LINK_SHARE, TEXT_SHARE, HOST_PAGES, ALL_SHARE, ALL_HOSTS = 0.08, 0.12, 3, 0.016, 3
#: The same share for list items: those of main bodies recur too, as an ingredient does, so most pages must show one.
ITEM_SHARE = 0.5
#: Winning paths that may be sent to every task (in a table of 17 bytes a path); beyond it, pages meet the paths of their
#: host in groups of so many pages at most, about.
BROADCAST_PATHS, GROUP_PAGES = 300_000, 4000
#: Scores are counted in these parts; the key under which the pages of a host are counted.
PARTS, EVERY = 1000, 0

#: Characters of a part of a row of links, on average; a row of few parts may have as many as one of ``SHORT_ROW``.
ROW_PART, SHORT_ROW = 40, 4
#: Words of a path that is sought inside a line of paths without separators.
JOINED = 12

_ROW = re.compile(r"\s+(?:[>›»|·•/→])\s+|\s{2,}|\t")
_END = re.compile(r"[.!?…][\"”“’»)\]]*$")
_ITEM = re.compile(r"^(?:[-•*–]\s*)?\d+(?:[.,]\d+)?\s*(?:g|mg|µg|kg|ml|cl|dl|l|el|tl|stück|prisen?)\b", re.I)
_BULLET = re.compile(r"^[-•*–]\s")
_DIGITS = re.compile(r"\d+")
_RIGHTS = re.compile(r"©|^copyright\b|\ball rights reserved\b|\balle rechte vorbehalten\b", re.I)
#: Put before the text of list items.
_MARK = "\0"
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def path_key(text: str) -> int:
    """A stable 64-bit number of a generalised line; numbers stay in one that is marked as a list item."""
    level = " ".join(text.lower().split())
    return hash64(level if level.startswith(_MARK) else _DIGITS.sub("#", level))


def kind_of(line: str) -> str:
    """``b`` blank, ``i`` list item, ``s`` sentence, ``r`` row of links, ``t`` title-like."""
    text = line.strip()
    if not text:
        return "b"
    if _ITEM.match(text) or _BULLET.match(text):
        return "i"
    parts = len(_ROW.split(text))
    if parts > 1 and len(text) <= ROW_PART * max(parts, SHORT_ROW):
        return "r"
    if len(text) <= 110 and (not _END.search(text) or text[-1] == "?" or len(text.split()) < 5):
        return "t"
    return "s"


def _linked(text: str) -> bool:
    """Whether a line may be a bulleted link, which an item of a recipe is not."""
    return bool(_BULLET.match(text)) and not _ITEM.match(text)


class _Keys(dict):
    def __missing__(self, text: str) -> int:
        value = self[text] = path_key(text)
        return value


class Reader:
    """Reads the lines of pages as paths."""

    def __init__(self) -> None:
        self.keys = _Keys()
        self.kinds: dict[str, str] = {}

    def lines(self, text: str) -> list[tuple[str, str]]:
        kinds = self.kinds
        if len(kinds) > 300_000:
            kinds.clear()
            self.keys.clear()
        out = []
        for line in text.split("\n"):
            kind = kinds.get(line)
            if kind is None:
                kind = kinds[line] = kind_of(line)
            out.append((line.strip(), kind))
        return out

    def _key(self, line: str, kind: str) -> int:
        return self.keys[_MARK + line if kind == "i" else line]

    def scores(self, lines: list[tuple[str, str]]) -> list[float]:
        """The score of each line's container: the share of running text in it."""
        out = [0.0] * len(lines)
        members: list[int] = []
        sort = ""
        for i in range(len(lines) + 1):
            here = "" if i == len(lines) or lines[i][1] == "b" else "link" if lines[i][1] in "tr" else "text"
            if here != sort and not (i < len(lines) and not here):
                # a title right above running text belongs to its container
                title = [members.pop()] if sort == "link" and here == "text" and members and lines[members[-1]][1] == "t" else []
                running = sum(len(lines[k][0]) for k in members if lines[k][1] in "si")
                total = sum(len(lines[k][0]) for k in members)
                for k in members:
                    out[k] = running / total
                members, sort = title, here
            if here:
                members.append(i)
        return out

    def votes(self, text: str) -> dict[int, tuple[int, int]]:
        """Path to the score of its container and what else the page says of it: 1 content came before, 2 a title-like line
        follows, 4 it is a list item."""
        lines = self.lines(text)
        scores = self.scores(lines)
        before, out = False, {}
        for i, (line, kind) in enumerate(lines):
            if kind == "b":
                continue
            follows = i + 1 < len(lines) and (lines[i + 1][1] == "t" or _linked(lines[i + 1][0]))
            key = self._key(line, kind)
            score, flags = out.get(key, (0, 0))
            out[key] = max(score, int(PARTS * scores[i])), flags | before | 2 * follows | 4 * (kind == "i")
            if kind == "r":
                for part in _ROW.split(line):
                    if part:
                        out.setdefault(self.keys[part], (0, 0))
            before = before or kind in "si" and len(line) > 60
        return out

    def furniture(self, text: str, won, opens) -> list[int]:
        """Numbers (from 1) of the non-blank lines that are no main content, given tests for winning paths and labels."""
        lines = self.lines(text)
        out, before, links = [], False, False
        wrapped = {n for n in range(2, len(lines) + 1) if self._wrapped(lines[n - 2], lines[n - 1], won)}
        for i, (line, kind) in enumerate(lines, 1):
            if kind == "b":
                links = False
                continue
            key = self._key(line, kind)
            if i in wrapped or i + 1 in wrapped:
                links = False
                out.append(i)
            elif won(key) or _RIGHTS.search(line):
                links = before and opens(key)
                out.append(i)
            elif kind == "r" and self._row(line, won) or kind in "tr" and self._joined(line, won):
                links = False
                out.append(i)
            elif links and (kind == "t" or _linked(line)):
                out.append(i)
            else:
                links, before = False, True
        return out

    def _wrapped(self, above: tuple[str, str], below: tuple[str, str], won) -> bool:
        """Whether two lines are one winning path that was wrapped."""
        if not above[0] or not below[0][:1].islower():
            return False
        return won(self.keys[f"{above[0]} {below[0]}"])

    def _row(self, line: str, won) -> bool:
        parts = [p for p in _ROW.split(line) if p]
        winning = sum(won(self.keys[p]) for p in parts)
        return bool(parts) and (won(self.keys[parts[0]]) or 2 * winning >= len(parts))

    def _joined(self, line: str, won) -> bool:
        """Whether the line is winning paths side by side."""
        words = line.split()
        reach = {0}
        for start in range(len(words)):
            if start in reach:
                reach.update(stop for stop in range(start + 1, min(start + JOINED, len(words)) + 1) if stop - start < len(words) and won(self.keys[" ".join(words[start:stop])]))
        return len(words) > 1 and len(words) in reach


_VOTES = ("pages", "score", "after", "opening", "item")


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``host, key`` with the votes for a path, summed over each batch; under one key the pages of the host."""
    reader = Reader()
    for batch in batches:
        seen: dict[tuple[int, int], list[int]] = {}
        for text, host in zip(batch.column("text").to_pylist(), batch.column("host").to_pylist()):
            seen.setdefault((host, EVERY), [0] * len(_VOTES))[0] += 1
            for key, (score, flags) in reader.votes(text).items():
                row = seen.setdefault((host, key), [0] * len(_VOTES))
                row[0] += 1
                row[1] += score
                row[2] += flags & 1
                row[3] += flags >> 1 & 1
                row[4] += flags >> 2
        columns = list(zip(*[(h, k if k < 1 << 63 else k - (1 << 64), *v) for (h, k), v in seen.items()])) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "key", *_VOTES])


def pages_of(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``chunk_id, text, host`` of every HTML chunk once. The host is the page's file name without its number; where the
    source is null, the name comes from the file of the chunk's document."""
    html = chunks.where(F.col("metadata.doc_type") == "HTML").where(F.length("text") > 0)
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"_\d+\.html?$", "")
    given = html.select("chunk_id", "doc_id", "text", name(F.col("metadata.source")).alias("name"))
    known = given.where("name is not null")
    lost = given.where("name is null").join(files.select("doc_id", name(F.col("path")).alias("path_name")), "doc_id", "left")
    both = known.select("chunk_id", "text", "name").unionByName(lost.select("chunk_id", "text", F.coalesce("path_name", F.lit("")).alias("name")))
    return both.select("chunk_id", "text", F.xxhash64("name").alias("host")).distinct()


def winning_paths(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, key, opens`` of the paths that win on a host, and ``host, host_pages``. A host is never gathered: votes are
    summed in each batch, then by host and path, and written once; shares come from small tables of pages per host and of
    paths that many hosts show."""
    votes = pages.mapInArrow(_voted, "host bigint, key bigint, " + ", ".join(f"{c} bigint" for c in _VOTES))
    counted = staged(votes.groupBy("host", "key").agg(*[F.sum(c).alias(c) for c in _VOTES]))
    hosts = counted.where(F.col("key") == EVERY).select("host", F.col("pages").alias("host_pages"))
    by_path = counted.where(F.col("key") != EVERY)
    total = hosts.agg(F.sum("host_pages").alias("n")).first()["n"] or 0
    mean = F.col("score") / (PARTS * F.col("pages"))
    needed = F.when(F.col("item") > 0, ITEM_SHARE).otherwise(LINK_SHARE + (TEXT_SHARE - LINK_SHARE) * mean)
    local = (F.col("pages") >= HOST_PAGES) & (F.col("pages") >= needed * F.col("host_pages"))
    scored = by_path.join(hosts, "host").withColumn("local", local)
    everywhere = scored.groupBy("key").agg(F.sum("pages").alias("all_pages"), F.count("*").alias("hosts"), F.count_if("local").alias("wins"), F.sum("after").alias("all_after"), F.sum("opening").alias("all_opening"), F.max("item").alias("all_item"))
    recurs = (F.col("all_pages") >= ALL_SHARE * F.lit(total)) & (F.col("hosts") >= ALL_HOSTS) & (F.col("all_item") == 0)
    common = everywhere.where(recurs | (F.col("wins") >= ALL_HOSTS))
    both = scored.join(common, "key", "left")
    n, after, opening = (F.coalesce(a, b) for a, b in (("all_pages", "pages"), ("all_after", "after"), ("all_opening", "opening")))
    opens = (after >= 0.5 * n) & (opening >= 0.5 * n)
    return both.where(F.col("local") | F.col("all_pages").isNotNull()).select("host", "key", opens.alias("opens")), hosts


def _mixed(host: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(host.view(np.uint64) * np.uint64(_GOLD) + key.view(np.uint64))


def furniture_lines(pages: DataFrame) -> DataFrame:
    """``chunk_id, line_no`` of every non-blank line that is no main content, lines counted from 1 with blank ones.

    Pages without furniture give no rows; null and empty texts are no pages. The winning paths are sent to every task where
    their number is within a checked bound; beyond it pages and paths of a host are brought together in groups.
    """
    paths, hosts = winning_paths(pages)
    won = staged(paths)
    schema = "chunk_id bigint, line_no int"
    if won.count() <= BROADCAST_PATHS:
        rows = won.toPandas()
        codes = _mixed(rows["host"].to_numpy(np.int64), rows["key"].to_numpy(np.int64))
        order = np.argsort(codes)
        shared = pages.sparkSession.sparkContext.broadcast((codes[order], rows["opens"].to_numpy(bool)[order]))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, opens = shared.value
            tables: dict[int, dict[int, bool]] = {}
            known = dict(zip(codes.tolist(), opens.tolist()))
            reader = Reader()
            for batch in batches:
                yield _read(batch, reader, lambda host, key: known.get(_code(host, key)), tables)

        return pages.mapInArrow(read, schema)
    # pages and paths of a host meet in as many groups as the host needs; a host has few paths, as each needs a share of its pages
    groups = hosts.select("host", (F.col("host_pages") / GROUP_PAGES).cast("int").alias("last"))
    dealt = pages.join(groups, "host").select("chunk_id", "text", "host", F.pmod(F.xxhash64("chunk_id"), F.col("last") + 1).cast("int").alias("part"))
    copied = won.join(groups, "host").select("host", F.explode(F.sequence(F.lit(0), "last")).alias("part"), "key", "opens")

    def read_group(pages: pa.Table, paths: pa.Table) -> pa.Table:
        known = dict(zip((k & _MASK for k in paths.column("key").to_pylist()), paths.column("opens").to_pylist()))
        reader = Reader()
        read = [_read(batch, reader, lambda host, key: known.get(key), {}) for batch in pages.to_batches()]
        return pa.Table.from_batches(read, pa.schema([("chunk_id", pa.int64()), ("line_no", pa.int32())]))

    return dealt.groupBy("host", "part").cogroup(copied.groupBy("host", "part")).applyInArrow(read_group, schema)


def _code(host: int, key: int) -> int:
    x = (host * _GOLD + key) & _MASK
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _MASK
    return x ^ x >> 33


def _read(batch: pa.RecordBatch, reader: Reader, look, tables: dict) -> pa.RecordBatch:
    ids, numbers = [], []
    for chunk_id, text, host in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "text", "host"))):
        table = tables.setdefault(host, {})
        if len(table) > 200_000:
            table.clear()

        def find(key: int, table=table, host=host):
            if key not in table:
                table[key] = look(host, key)
            return table[key]

        got = reader.furniture(text, lambda key: find(key) is not None, lambda key: bool(find(key)))
        ids += [chunk_id] * len(got)
        numbers += got
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["chunk_id", "line_no"])


def main_bodies(pages: DataFrame) -> DataFrame:
    """``chunk_id, body``: the main content of each page, its lines in order without the furniture."""
    cut = furniture_lines(pages).groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut"))
    lines = pages.groupBy("chunk_id").agg(F.min("text").alias("text")).join(cut, "chunk_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains("cut", (i + 1).cast("int")), F.lit(False)))
    return lines.select("chunk_id", F.trim(F.array_join(kept, "\n")).alias("body"))
