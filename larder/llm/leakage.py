"""Evaluation texts inside a corpus.

Winnowing: of every window of consecutive k-grams of words the smallest hash is kept as a fingerprint. With k = 5 and
windows of 6, any shared run of ten words shares a fingerprint. The fingerprints of corpus and test texts are joined, and
each hit is extended to the longest common run around it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import may_hold, staged
from larder.llm.words import WordHasher, windows
from larder.sources.tables import bounded_rows, spread

#: Words of a fingerprinted run, fingerprinted runs in a window, and words that make a case: RUN + WINDOW - 1 = CASE.
RUN, WINDOW, CASE = 5, 6, 10
#: Test items up to which, within a checked number of bytes, the fingerprints of the test side go to every task.
BROADCAST_ITEMS = 20_000
#: Items with a fingerprint from which it is a common phrase.
COMMON = 50

_WORDS = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")
_PLAIN = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "ẞ": "ss"})
_UNUSUAL = re.compile(r"[^\x00-\x7fäöüßÄÖÜẞ–„“”»«…°µ·•’‚‘]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_TWO = re.compile(r"([aou])e")


def normal_words(text: str | None) -> list[str]:
    """Words of a text such that case, punctuation, mark-up signs, spacing, line breaks, invisible characters and the
    writing of umlauts and ß make no difference."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if _UNUSUAL.search(text):
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).replace("ß", "ss").replace("ẞ", "ss"))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORDS.findall(_TWO.sub(r"\1", text.lower().translate(_PLAIN)))


def winnow(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of several texts: ``(text, position in text, hash)``; the rightmost smallest of each window."""
    grams, owner = windows(flat, counts, RUN)
    if not len(grams):
        return owner, owner, grams
    size = np.bincount(owner, minlength=len(counts))
    first = np.cumsum(size) - size
    place = np.arange(len(grams)) - first[owner]
    chosen = np.zeros(len(grams), bool)
    if len(grams) >= WINDOW:
        view = sliding_window_view(grams, WINDOW)
        inside = owner[: len(view)] == owner[WINDOW - 1 :]
        low = WINDOW - 1 - np.argmin(view[:, ::-1], axis=1)
        chosen[(np.arange(len(view)) + low)[inside]] = True
    short = size[owner] < WINDOW
    if short.any():
        least = np.full(len(counts), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, owner[short], grams[short])
        chosen |= short & (grams == least[owner])
    return owner[chosen], place[chosen], grams[chosen]


def run_around(a: list, b: list, i: int, j: int) -> int:
    """Length of the common run of two word lists around the positions i and j."""
    back = 0
    while i - back > 0 and j - back > 0 and a[i - back - 1] == b[j - back - 1]:
        back += 1
    on = 0
    while i + on < len(a) and j + on < len(b) and a[i + on] == b[j + on]:
        on += 1
    return back + on if on else 0


class _Items:
    """Fingerprints of the test side: hash to the items and positions that have it."""

    def __init__(self, rows: list):
        self.ids = [r[0] for r in rows]
        self.words = [normal_words(r[1]) for r in rows]
        flat, counts = WordHasher().flat(self.words)
        self.places: dict[int, list[tuple[int, int]]] = {}
        for owner, place, value in zip(*(x.tolist() for x in winnow(flat, counts))):
            self.places.setdefault(value, []).append((owner, place))
        self.hashes = np.array(sorted(self.places), np.uint64)


def leaked(documents: DataFrame, items: DataFrame, case: int = CASE) -> DataFrame:
    """``doc_id, item_id, words`` of every document that holds at least ``case`` successive words of an item, with the
    longest run. ``documents`` has ``doc_id, text`` and ``items`` has ``item_id, text``.

    Where the test side is small, which is checked, its fingerprints go to every task and one narrow pass winnows, joins
    and extends; larger test sides are joined on the fingerprint with what stands around it, and texts move only for real hits. Null, empty and short texts are no
    case. Texts of fewer than ``case`` words on the test side cannot give a case.
    """
    rows = bounded_rows(items.where("text is not null").select("item_id", "text").distinct(), BROADCAST_ITEMS)
    return _leaked_narrow(documents, rows, case) if rows is not None else _leaked_joined(documents, items, case)


def _leaked_narrow(documents: DataFrame, rows: list, case: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(_Items(rows))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, hasher = shared.value, WordHasher()
        for batch in batches:
            words = [normal_words(t) for t in batch["text"]]
            flat, counts = hasher.flat(words)
            owner, place, value = winnow(flat, counts)
            at = np.searchsorted(items.hashes, value)
            hit = np.flatnonzero((at < len(items.hashes)) & (items.hashes[np.minimum(at, len(items.hashes) - 1)] == value)) if len(items.hashes) else []
            best: dict[tuple[int, int], int] = {}
            for h in hit:
                doc, p = int(owner[h]), int(place[h])
                for item, q in items.places[int(value[h])]:
                    length = run_around(words[doc], items.words[item], p, q)
                    best[doc, item] = max(length, best.get((doc, item), 0))
            ids = batch["doc_id"].to_numpy()
            yield pd.DataFrame([(ids[d], items.ids[i], n) for (d, i), n in best.items() if n >= case], columns=["doc_id", "item_id", "words"])

    found = spread(documents.select("doc_id", "text").where("text is not null")).mapInPandas(scan, "doc_id bigint, item_id bigint, words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _around(flat: np.ndarray, counts: np.ndarray, owner: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each fingerprint the hashes of the runs of ``CASE`` words of its text that hold it."""
    runs, of = windows(flat, counts, CASE)
    number = np.maximum(counts - CASE + 1, 0)
    first = np.cumsum(number) - number
    low = np.maximum(place - (CASE - RUN), 0)
    high = np.minimum(place + 1, number[owner])
    return [runs[first[o] + a : first[o] + b] if b > a else runs[:0] for o, a, b in zip(owner.tolist(), low.tolist(), high.tolist())]


def _fingerprints(df: DataFrame, key: str) -> DataFrame:
    """``key, hash, around`` of the fingerprints of each text that lie in a run of ``CASE`` words, with the hashes of these."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            flat, counts = hasher.flat([normal_words(t) for t in batch["text"]])
            owner, place, value = winnow(flat, counts)
            around = [x.view(np.int64) for x in _around(flat, counts, owner, place)]
            made = pd.DataFrame({key: batch[key].to_numpy()[owner], "hash": value.view(np.int64), "around": around})
            yield made[[len(x) > 0 for x in around]]

    return spread(df.select(key, "text").where("text is not null")).mapInPandas(scan, f"{key} bigint, hash bigint, around array<bigint>")


def _hits(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """``doc_id, item_id`` that share a fingerprint and a whole run of ``CASE`` words around it.

    A fingerprint that few items have is joined as it is, and hits that do not agree around it go no further than the join. One
    that many items have, a common phrase, is joined by the runs around it instead, so that only real cases come out of it.
    """
    common = staged(tests.select("item_id", "hash").distinct().groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("hash"))
    rare = docs.join(common, "hash", "left_anti").join(tests.join(common, "hash", "left_anti").withColumnRenamed("around", "other"), "hash")
    agree = rare.where(F.arrays_overlap("around", "other")).select("doc_id", "item_id")
    runs = lambda df, key: df.join(common, "hash").select(key, F.explode("around").alias("run")).distinct()
    return agree.unionByName(runs(docs, "doc_id").join(runs(tests, "item_id"), "run").select("doc_id", "item_id")).distinct()


def _leaked_joined(documents: DataFrame, items: DataFrame, case: int) -> DataFrame:
    hits = staged(_hits(staged(_fingerprints(documents, "doc_id")), staged(_fingerprints(items, "item_id"))))
    # only texts that are in a hit move
    held = {key: may_hold(hits.select(key), key) for key in ("doc_id", "item_id")}
    docs = documents.where("text is not null").where(held["doc_id"](F.col("doc_id"))).select("doc_id", F.col("text").alias("doc_text")).distinct()
    tests = items.where("text is not null").where(held["item_id"](F.col("item_id"))).select("item_id", F.col("text").alias("item_text")).distinct()

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, item_id, a, b in zip(batch["doc_id"], batch["item_id"], batch["doc_text"], batch["item_text"]):
                one = _Items([(item_id, b)])
                words = normal_words(a)
                _, place, value = winnow(*WordHasher().flat([words]))
                runs = [run_around(words, one.words[0], p, q) for p, v in zip(place.tolist(), value.tolist()) for _, q in one.places.get(v, ())]
                if runs and max(runs) >= case:
                    out.append((doc_id, item_id, max(runs)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words"])

    found = hits.join(docs, "doc_id").join(tests, "item_id").mapInPandas(extend, "doc_id bigint, item_id bigint, words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
