"""Noise in text from scanned pages.

Method: the lines of a scanned text are a sequence, labelled by a hidden Markov model with the states header, page number,
heading, body and break. A line is observed through several layout features, each of which has its own distribution in each
state: its shape, how full it is, how it begins and ends, whether it is the first or last, whether it comes again in the text and
on how many others, whether the next word would have fitted, whether a sentence runs into it, how many words it has. The
model starts from the few lines whose state their shape gives away, and is re-estimated by hard EM on a bounded sample of
texts, so that lines without such a shape are decided by all their features and by the states around them. Words broken
across lines are joined by the labels, and misread words are those that turn into far more frequent words when a usual
misreading is undone. Word counts and recurring lines are taken over all texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.staging import hash_sample, staged
from larder.sources.tables import bounded_rows, spread

#: Texts that the model is fitted on, at most, and rounds of hard EM.
SAMPLE, ROUNDS = 4000, 3
#: Different scanned texts on which a line recurs, by steps; the first is the least that is kept.
RECURS = (3, 6, 20)
#: Recurring lines that may be sent to every task; more are joined.
BROADCAST_LINES = 300_000
#: A word is misread if undoing a misreading gives a word at least so many times as frequent, and that often at least.
TIMES, LEAST = 8, 4
#: Longest word in which a misreading is undone in one place at a time: a longer run of characters has as many variants of
#: its own length as it has letters.
USUAL_WORD = 100
#: Misread words that may be sent to every task; more are joined.
BROADCAST_WORDS = 300_000

#: What scanners make of letters, misread form first.
MISREADINGS = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("6", "ö"), ("9", "g"), ("8", "b"), ("4", "a"), ("3", "e"),
    ("†", "t"), ("¡", "i"), ("|", "l"), ("!", "l"), ("ﬂ", "fl"), ("ﬁ", "fi"), ("€", "e"),
    ("cl", "d"), ("li", "h"), ("rn", "m"), ("m", "rn"), ("c", "e"), ("ii", "u"), ("ii", "ü"), ("ii", "ä"), ("vv", "w"), ("b", "ß"),
)
_SIGNS = re.compile(r"[†¡ﬂﬁ€]|[^\W\d_]\d+[^\W\d_]|^\d[^\W\d_]{3,}|[^\W\d_]{4,}\d$|[^\W\d_]\|[^\W\d_]")
HYPHENS = "-¬\xad‐‑"
#: Words after a hyphen that stands for an omitted part.
JOINERS = {"und", "oder", "bis", "bzw", "sowie", "als", "noch", "and", "or"}

_PAGE = re.compile(r"^\W*(?:(?:seite|s\.|page|p\.)\s*)?[\dOolI]*\d[\dOolI]*(?:\s*(?:/|von|of)\s*\d+)?\W*$", re.I)
_DETACHED = re.compile(r"^\d+\s{2,}\S|\S\s{2,}\d+$")
_HEADING = re.compile(r"^\d+(?:\.\d+)+\.?\s+\S")
_ENDED = re.compile(r"[.!?:][\"”“»)]*$")
_SPACED = re.compile(r"(?:[^\W\d_] ){4,}[^\W\d_]\b")
_EDGE = re.compile(r"^[^\w†¡|ﬂﬁ€]+|[^\w†¡|ﬂﬁ€]+$")
_SPOKEN = re.compile(r"[^\W\d_]")
_FOLD = str.maketrans({"1": "i", "l": "i", "0": "o", "5": "s", "6": "b", "9": "g", "†": "t", "¡": "i"})

#: States of the model.
HEADER, PAGE_NO, HEADING, BODY, BREAK = range(5)
#: Shapes of a line.
BLANK, NUMBER, DETACHED, NUMBERED, TEXT = range(5)
#: Layout features of a line with the number of their values.
FEATURES = {"shape": 5, "fullness": 6, "begins": 4, "ends": 6, "edge": 3, "again": 2, "recurs": 4, "room": 5, "flow": 3, "words": 5}
_SHAPE, _FULL, _BEGINS, _ENDS, _PLACE, _AGAIN, _RECURS, _ROOM, _FLOW, _WORDS = range(len(FEATURES))
_NOTHING = (BLANK,) + (0,) * (len(FEATURES) - 1)
#: How the states follow each other before anything is fitted, and how many lines of each state that weighs.
_MOVE = np.array(
    [
        [0.02, 0.20, 0.10, 0.58, 0.10],
        [0.40, 0.02, 0.10, 0.36, 0.12],
        [0.01, 0.01, 0.01, 0.93, 0.04],
        [0.05, 0.06, 0.02, 0.83, 0.04],
        [0.06, 0.08, 0.10, 0.75, 0.01],
    ]
)
PRIOR = 200
#: Weight of each feature: as they are not independent, each counts for less than alone.
WEIGHT = 0.8


def folded(line: str) -> str:
    """A line as a running header is compared: numbers as ``#``, misread letters and case levelled."""
    text = re.sub(r"^\d+\s{2,}|\s{2,}\d+$", "", line.strip())
    text = re.sub(r"(?<!\w)\d+(?!\w)", "#", text).lower()
    for wrong, right in (("cl", "d"), ("li", "h"), ("rn", "m"), ("ii", "u"), ("c", "e")):
        text = text.replace(wrong, right)
    return text.translate(_FOLD)


def is_scan(text: str | None) -> bool:
    """Whether a text is set in lines as a page is: many of its lines break within sentences. Rows of tables do not count."""
    if not text or "\n" not in text:
        return False
    long = [x for x in map(str.strip, text.split("\n")) if len(x) > 30 and x[0] != "|"]
    broken = sum(1 for x in long if not _ENDED.search(x))
    return broken >= 2 and broken >= 0.4 * len(long)


def _width(bare: list[str], shape: list[int]) -> int:
    """Length of the longest line of text that others come near to: one stray line makes no width."""
    lengths = sorted(len(x) for x, s in zip(bare, shape) if s == TEXT and not _SPACED.search(x))
    if not lengths:
        return 0
    usual = lengths[-1 - len(lengths) // 4]
    return max(n for n in lengths if n <= 1.25 * usual)


def header_key(line: str) -> str:
    """What of a line would come again if it were a running header."""
    return folded(line).split(" · ")[0]


def may_recur(line: str, shape: int) -> bool:
    return shape in (TEXT, DETACHED) and line[-1] not in HYPHENS and (line[0].isupper() or shape == DETACHED or line[0] in "†¡|")


def shape_of(line: str) -> int:
    if not line:
        return BLANK
    if _PAGE.match(line):
        return NUMBER
    if _DETACHED.search(line):
        return DETACHED
    return NUMBERED if _HEADING.match(line) else TEXT


def observed(lines: list[str], recurs) -> np.ndarray:
    """The features of each line; ``recurs`` gives the number of texts that show a line, None if they are few."""
    bare = [x.strip() for x in lines]
    shape = [shape_of(x) for x in bare]
    width = max(_width(bare, shape), 1)
    keys = [header_key(x) if may_recur(x, s) else "" for x, s in zip(bare, shape)]
    count = Counter(k for k in keys if k)
    n = len(bare)
    above, below, last = [-1] * n, [-1] * n, -1
    for i in range(n):
        above[i] = last
        if shape[i] not in (BLANK, NUMBER):
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        below[i] = last
        if shape[i] not in (BLANK, NUMBER):
            last = i
    out = []
    for i, x in enumerate(bare):
        s = shape[i]
        if s == BLANK:
            out.append(_NOTHING)
            continue
        core = re.sub(r"^\d+\s{2,}|\s{2,}\d+$", "", x) if s == DETACHED else x
        full = bisect_right((0.3, 0.5, 0.7, 0.9, 1.001), len(core) / width)
        first = core[0]
        begins = 0 if first.isupper() else 1 if first.islower() else 2 if first.isdigit() else 3
        ends = 5 if core[-1] == "?" else 0 if _ENDED.search(core) else 1 if core[-1] in ",;:" else 2 if core[-1] in HYPHENS else 3 if core[-1].isdigit() else 4
        edge = 1 if i == 0 else 2 if i + 1 == n else 0
        seen = recurs(keys[i]) if keys[i] else None
        below_i, above_i = below[i], above[i]
        if below_i < 0:
            room = 4
        else:
            spaced = _SPACED.match(bare[below_i])
            word = spaced.group() if spaced else bare[below_i].split()[0]
            room = bisect_right((0, 2, 6), width - len(core) - 1 - len(word))
        flow = int(above_i >= 0 and shape[above_i] == TEXT and not _ENDED.search(bare[above_i]))
        if not flow and below_i >= 0 and bare[below_i][0].islower():
            flow = 2
        words = bisect_right((2, 4, 7, 10), len(core.split()))
        out.append((s, full, begins, ends, edge, int(bool(keys[i]) and count[keys[i]] > 1), bisect_right(RECURS, seen or 0), room, flow, words))
    return np.array(out, np.int64).reshape(n, len(FEATURES))


def _given_away(seen: np.ndarray) -> np.ndarray:
    """States of the lines whose shape, or the sentence that runs through them, gives them away, else -1."""
    state = np.full(len(seen), -1)
    for shape, known in ((BLANK, BREAK), (NUMBER, PAGE_NO), (DETACHED, HEADER), (NUMBERED, HEADING)):
        state[seen[:, _SHAPE] == shape] = known
    full = (seen[:, _FULL] >= 4) & (seen[:, _ROOM] == 0) & (seen[:, _AGAIN] == 0) & (seen[:, _RECURS] == 0)
    inside = (seen[:, _FLOW] == 1) & ((seen[:, _ENDS] == 0) | (seen[:, _BEGINS] == 1))
    state[(seen[:, _SHAPE] == TEXT) & (full | inside)] = BODY
    return state


#: A page that shows every state once, so that a small corpus has them all; states as first letters.
EXAMPLE = """Kleines Handbuch der Vorratshaltung   11
Getreide hält sich in trockenen Räumen über viele Mo-
nate, wenn die Säcke nicht auf dem Boden stehen. Wer
Mehl lagert, sollte es im Frühjahr sieben und danach
in Gläser füllen.
11
Kleines Handbuch der Vorratshaltung
Hülsenfrüchte brauchen weniger Pflege als Getreide und

bleiben über mehrere Jahre genießbar, sofern die Luft
im Keller trocken ist.
2.4 Gemüse im Winter
Kohl und Rüben werden in feuchtem Sand gelagert, damit
sie nicht welken. Einmal in der Woche wird die oberste
Schicht geprüft.
12
Kleines Handbuch der Vorratshaltung"""
EXAMPLE_STATES = "hbbbbphbkbbsbbbph"


class LineModel:
    """A hidden Markov model over the layout features of lines."""

    def __init__(self) -> None:
        self.emit = [np.zeros((5, n)) for n in FEATURES.values()]
        self.move = np.log(_MOVE)

    def _estimate(self, seen: np.ndarray, state: np.ndarray, before: np.ndarray, after: np.ndarray, shaped: bool) -> None:
        for f, n in enumerate(FEATURES.values()):
            counts = np.bincount(state * n + seen[:, f], minlength=5 * n).reshape(5, n) + 0.5
            if f == _SHAPE and not shaped:
                # the lines that their shape gave away say nothing about headers and text without one
                counts[HEADER] = counts[HEADER].sum() * np.array([0.002, 0.002, 0.5, 0.002, 0.494])
            self.emit[f] = np.log(counts / counts.sum(1, keepdims=True)) * (1.0 if f == _SHAPE else WEIGHT)
        moves = np.bincount(before * 5 + after, minlength=25).reshape(5, 5) + PRIOR * _MOVE
        self.move = np.log(moves / moves.sum(1, keepdims=True))

    def fit(self, sequences: list[np.ndarray], rounds: int = ROUNDS) -> LineModel:
        """Hard EM from the lines that are given away."""
        sequences = [x for x in sequences if len(x)]
        none, own = np.zeros(0, np.int64), observed(EXAMPLE.split("\n"), {}.get)
        own_states = np.array(["hpsbk".index(x) for x in EXAMPLE_STATES])
        given = np.concatenate([own, *sequences])
        state = np.concatenate([own_states, *(_given_away(x) for x in sequences)])
        known = state >= 0
        self._estimate(given[known], state[known], none, none, False)
        for _ in range(rounds):
            labelled = self.label(sequences)
            pairs = [(x[:-1], x[1:]) for x in labelled]
            seen, state = np.concatenate([own, *sequences]), np.concatenate([own_states, *labelled])
            self._estimate(seen, state, np.concatenate([none, *(a for a, _ in pairs)]), np.concatenate([none, *(b for _, b in pairs)]), True)
        return self

    def label(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of the lines of many texts (Viterbi, over all texts of like length at once)."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        by_length = sorted((k for k, x in enumerate(sequences) if len(x)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(by_length):
            group = [k for k in by_length[at : at + 512] if len(sequences[k]) <= 2 * len(sequences[by_length[at]]) + 4]
            at += len(group)
            lengths = np.array([len(sequences[k]) for k in group])
            where = np.arange(lengths.max())[None, :] < lengths[:, None]
            seen = np.concatenate([sequences[k] for k in group])
            scored = np.zeros((*where.shape, 5))
            scored[where] = sum(self.emit[f][:, seen[:, f]] for f in range(len(FEATURES))).T
            score, back = [scored[:, 0]], []
            for i in range(1, where.shape[1]):
                reach = score[-1][:, :, None] + self.move
                back.append(reach.argmax(1))
                score.append(scored[:, i] + reach.max(1))
            states = np.zeros(where.shape, np.int64)
            rows = np.arange(len(group))
            current = np.zeros(len(group), np.int64)
            for i in range(where.shape[1] - 1, -1, -1):
                current = np.where(lengths - 1 == i, score[i].argmax(1), current)
                states[:, i] = current
                if i:
                    current = back[i - 1][rows, current]
            for r, k in enumerate(group):
                out[k] = states[r, : lengths[r]]
        return out


def bare_word(token: str) -> str:
    return _EDGE.sub("", token).lower()


def unread(word: str) -> set[str]:
    """What a word would be if one usual misreading is undone, everywhere or, in words of usual length, in one place."""
    out = set()
    for wrong, right in MISREADINGS:
        at = word.find(wrong)
        if at < 0:
            continue
        out.add(word.replace(wrong, right))
        while at >= 0 and len(word) <= USUAL_WORD:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    out.discard(word)
    return out


def layout(text: str, states) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, int]]]:
    """What the lines of a scanned text show by their states, as ``(line number from 1, kind)``, and the words to look up, as
    ``(word, line of its first part, line of its second part, length of the first part)``."""
    lines = text.split("\n")
    out = {(i, "header" if s == HEADER else "page_no") for i, s in enumerate(states, 1) if s in (HEADER, PAGE_NO)}
    body = [i for i, s in enumerate(states) if s in (BODY, HEADING) and lines[i].strip()]
    asked: list[tuple[str, int, int, int]] = []
    head = None
    for n, i in enumerate(body):
        tokens = lines[i].split()
        following = lines[body[n + 1]].split() if n + 1 < len(body) else []
        last = tokens[-1]
        split = _is_split(last, following[0] if following else None)
        if head is not None:
            stem, owner = head
            asked.append((bare_word(stem + tokens[0]), owner + 1, i + 1, len(bare_word(stem))))
            if _SIGNS.search(bare_word(tokens[0])):
                out.add((i + 1, "char"))
        for token in tokens[head is not None : len(tokens) - split]:
            word = bare_word(token)
            if _SPOKEN.search(word):
                asked.append((word, i + 1, i + 1, len(word)))
                if _SIGNS.search(word):
                    out.add((i + 1, "char"))
        head = None
        if split:
            out.add((i + 1, "hyphen"))
            head = (last.rstrip(HYPHENS), i)
            if _SIGNS.search(bare_word(head[0])):
                out.add((i + 1, "char"))
    return sorted(out), asked


def misread_line(word: str, right: str, first: int, second: int, stem: int) -> int:
    """The line on which the misread part of a word stands."""
    where = next((k for k, (a, b) in enumerate(zip(word, right)) if a != b), len(word))
    return first if where < stem else second


def defects(text: str, states, misread) -> list[tuple[int, str]]:
    """``(line number from 1, kind)`` of a scanned text."""
    shown, asked = layout(text, states)
    out = set(shown)
    for word, first, second, stem in asked:
        right = misread(word)
        if right is not None:
            out.add((misread_line(word, right, first, second, stem), "char"))
    return sorted(out)


def _is_split(last: str, following: str | None) -> bool:
    """Whether the last word of a line goes on in the next one without its hyphen."""
    if len(last) < 2 or last[-1] not in HYPHENS or not (last[-2].isalpha() or last[-2] in "†¡ﬂﬁ" or last[-2].isdigit() and last[:-2][-1:].isalpha()):
        return False
    if last[-1] in "¬\xad":
        return True
    if following is None:
        return last[-2].islower()
    word = bare_word(following)
    return bool(word) and not following[0].isupper() and word not in JOINERS and (following[0].isalpha() or following[0] in "†¡ﬂﬁ" or bool(_SPOKEN.search(word)))


def paragraphs(text: str, states, misread) -> str:
    """The text as continuous paragraphs: headers, page numbers and line breaks gone, split words joined, misread words
    repaired where a reading is known."""
    lines = text.split("\n")
    width = max((len(x.strip()) for x in lines), default=0)
    out: list[str] = []
    current = ""
    body = [i for i, s in enumerate(states) if s in (BODY, HEADING) and lines[i].strip()]
    for n, i in enumerate(body):
        line = " ".join(lines[i].split())
        following = lines[body[n + 1]].split() if n + 1 < len(body) else []
        if states[i] == HEADING:
            out += [x for x in (current.strip(), line) if x]
            current = ""
            continue
        last = line.split()[-1]
        if _is_split(last, following[0] if following else None):
            current += line.rstrip(HYPHENS)
        elif last[-1] in HYPHENS and following and following[0][0].isupper():
            current += line
        elif re.search(r"[.!?][\"”“»)]*$", line) and len(line) < 0.6 * width:
            out.append(current + line)
            current = ""
        else:
            current += line + " "
    out += [current.strip()] if current.strip() else []

    def repaired(match: re.Match) -> str:
        token = match.group()
        right = misread(bare_word(token))
        if right is None:
            return token
        core = _EDGE.sub("", token)
        return token.replace(core, right.capitalize() if core[:1].isupper() else right, 1)

    return "\n".join(re.sub(r"\S+", repaired, p) for p in out)


def scans_of(chunks: DataFrame) -> DataFrame:
    """``chunk_id, text`` of PDF chunks that may be scanned pages: they have lines. The Python side looks closer."""
    return spread(_pdf(chunks).where(F.col("text").contains("\n")).select("chunk_id", "text"))


def _pdf(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("metadata.doc_type") == "PDF")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = Counter(chain.from_iterable(t.split() for t in batch.column(0).to_pylist() if t))
        words: Counter = Counter()
        for token, n in raw.items():
            word = bare_word(token)
            if len(word) > 1 and _SPOKEN.search(word):
                words[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def _undone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(w, n, v) for w, n in zip(batch["word"], batch["n"]) for v in unread(w)]
        yield pd.DataFrame(rows, columns=["word", "n", "right"])


def misread_words(chunks: DataFrame) -> DataFrame:
    """``word, right`` of every word of the corpus that is a misreading of a far more frequent one."""
    counts = staged(spread(chunks.select("text")).mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    undone = counts.mapInPandas(_undone, "word string, n bigint, right string")
    frequent = counts.where(F.col("n") >= LEAST).select(F.col("word").alias("right"), F.col("n").alias("right_n"))
    good = undone.join(frequent, "right").where(F.col("right_n") >= TIMES * F.col("n"))
    return good.groupBy("word").agg(F.max_by("right", F.struct("right_n", "right")).alias("right"))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each different line of a scanned text that might be a running header, once, with a hash of the text."""
    for batch in batches:
        rows: set[tuple[int, str]] = set()
        for text, copy in zip(batch["text"], batch["copy"]):
            if is_scan(text):
                bare = [x.strip() for x in text.split("\n")]
                rows.update((copy, header_key(x)) for x in bare if x and may_recur(x, shape_of(x)))
        yield pd.DataFrame(list(rows), columns=["copy", "key"])


def recurring_lines(scans: DataFrame) -> DataFrame:
    """``key, n``: folded lines that are shown by a least number of different scanned texts, which does not depend on how
    many texts there are, and the number of these texts. Counts are combined before the shuffle, copies count once."""
    shown = scans.select("text", F.xxhash64("text").alias("copy")).mapInPandas(_keys, "copy bigint, key string").distinct()
    return shown.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS[0])


class Page:
    """A scanned text that is read with the model."""

    def __init__(self, model: LineModel, lines: dict[str, int] | None):
        self.model, self.lines = model, lines

    def states(self, texts: list[str], own: list | None = None) -> list[np.ndarray]:
        """The states of the lines of each text; ``own`` are the recurring lines of each where they are not known to all."""
        known = [self.lines.get] * len(texts) if self.lines is not None else [dict(x if x is not None else ()).get for x in own]
        return self.model.label([observed(t.split("\n"), k) for t, k in zip(texts, known)])


def _tools(chunks: DataFrame):
    """The scans as ``chunk_id, text, lines`` with their own recurring lines if those are too many to be known to all, the
    misread words as a table, and the broadcast reader and words, the latter None if they are too many."""
    scans = scans_of(chunks)
    recurring = staged(recurring_lines(scans))
    rows = bounded_rows(recurring, BROADCAST_LINES)
    if rows is None:
        shown = scans.select("chunk_id", "text", F.col("chunk_id").alias("copy")).mapInPandas(_keys, "copy bigint, key string").join(recurring, "key")
        own = shown.groupBy(F.col("copy").alias("chunk_id")).agg(F.map_from_entries(F.collect_set(F.struct("key", "n"))).alias("lines"))
        scans = scans.join(own, "chunk_id", "left")
        lines = None
    else:
        scans = scans.withColumn("lines", F.lit(None).cast("map<string,bigint>"))
        lines = {r["key"]: r["n"] for r in rows}
    sample = sorted({r["text"]: r["lines"] for r in hash_sample(scans.select("text", "lines"), ["text"], _pdf(chunks).count(), SAMPLE) if is_scan(r["text"])}.items())
    page = Page(LineModel(), lines)
    page.model.fit([observed(t.split("\n"), (lines if lines is not None else own or {}).get) for t, own in sample])
    words = staged(misread_words(chunks))
    found = bounded_rows(words, BROADCAST_WORDS)
    known = None if found is None else {r["word"]: r["right"] for r in found}
    return scans, words, known, chunks.sparkSession.sparkContext.broadcast((page, known))


def _read(page: Page, batch: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The scanned texts of a batch with the states of their lines."""
    batch = batch[[is_scan(t) for t in batch["text"]]]
    return batch, page.states(batch["text"].tolist(), batch["lines"].tolist())


def _questions(scans: DataFrame, shared) -> DataFrame:
    """Every word to look up: ``chunk_id, word, first, second, stem``; only those that hold a usual misreading."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrong = [w for w, _ in MISREADINGS]
        for batch in batches:
            batch, states = _read(shared.value[0], batch)
            rows = [(c, *q) for c, t, s in zip(batch["chunk_id"], batch["text"], states) for q in layout(t, s)[1] if any(w in q[0] for w in wrong)]
            yield pd.DataFrame(rows, columns=["chunk_id", "word", "first", "second", "stem"])

    return scans.mapInPandas(ask, "chunk_id bigint, word string, first int, second int, stem int").distinct()


def scan_defects(chunks: DataFrame) -> DataFrame:
    """``chunk_id, line_no, kind`` of every noisy line of scanned pages: header, page_no, hyphen, char.

    Lines are counted from 1 with blank ones. Null and empty texts, texts that are not set in lines and other document
    types give no rows; re-delivered chunks count once. Misread words and recurring lines are sent to every task where their
    number is within a checked bound; beyond it the words and lines of the texts are joined with them.
    """
    scans, words, known, shared = _tools(chunks)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, known = shared.value
        for batch in batches:
            batch, states = _read(page, batch)
            rows = [(c, n, k) for c, t, s in zip(batch["chunk_id"], batch["text"], states) for n, k in defects(t, s, (known or {}).get)]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "kind"])

    found = scans.mapInPandas(find, "chunk_id bigint, line_no int, kind string")
    if known is None:
        place = F.udf(misread_line, T.IntegerType(), useArrow=True)
        joined = _questions(scans, shared).join(words, "word")
        found = found.unionByName(joined.select("chunk_id", place("word", "right", "first", "second", "stem").alias("line_no"), F.lit("char").alias("kind")))
    return found.distinct()


def repaired_texts(chunks: DataFrame) -> DataFrame:
    """``chunk_id, text`` of every scanned text as continuous paragraphs."""
    scans, words, known, shared = _tools(chunks)
    texts = scans.groupBy("chunk_id").agg(F.min("text").alias("text"), F.any_value("lines").alias("lines"))
    if known is None:
        own = _questions(scans, shared).join(words, "word").groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("own"))
        texts = texts.join(own, "chunk_id", "left")
    else:
        texts = texts.withColumn("own", F.lit(None).cast("map<string,string>"))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, known = shared.value
        for batch in batches:
            batch, states = _read(page, batch)
            rows = [(c, paragraphs(t, s, (known if known is not None else dict(o or {})).get)) for c, t, o, s in zip(batch["chunk_id"], batch["text"], batch["own"], states)]
            yield pd.DataFrame(rows, columns=["chunk_id", "text"])

    return texts.select("chunk_id", "text", "lines", "own").mapInPandas(repair, "chunk_id bigint, text string")
