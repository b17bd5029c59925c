"""Broken prompt and response pairs.

Method: a response is cut into clauses, and a linear-chain conditional random field tags each clause as answer, refusal,
echo, foreign, unfinished, error or nothing. The shares of a response that the tags cover are aggregated into at most one
defect of the pair; nothing but the tags decides.

The field is trained on all pairs of the corpus: on the driver where they are few, else in shards whose weights are averaged by
how often a shard has seen a feature; letters and words are counted over all texts. What it learns from is not what it sees: unfinished clauses are made
by breaking sound responses off, echoes by handing a query back, foreign clauses by answers to queries in another language
and by sound text in made-up letters; refusals, machine messages and empty responses are labelled by broad cues. What it sees
are the words, how far a clause runs along the query, how likely its letters are in the query's language, how it ends, and
the tags beside it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import staged
from larder.llm.words import WORD
from larder.sources.tables import spread

#: Distinct pairs up to which the field is trained on the driver, and that are worked on at once; pairs of a shard beyond it, about;
#: training responses that are made of sound ones, at least. All pairs are trained on at any size.
FEW, SHARD, MADE = 2500, 10_000, 1200
#: A word is heard if more answers have it than one, and than this share of all.
HEARD = 1 / 2500
#: Slices in which weights travel.
SLICES = 64
#: Clauses of a training response at most; longer ones are not trained on.
TRAINED = 24
#: How often a response of the sample with a refusal or a machine message is shown in a pass, as there are few.
RARE = 8
#: Passes of the training, responses of a step, step of the weights, pull towards zero.
PASSES, STEP_ROWS, STEP, PULL = 6, 64, 0.25, 2e-4
#: Hashed features; words and forms of features that a worker remembers before it starts anew.
HASHED, REMEMBERED = 1 << 16, 300_000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "error", "nothing")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, ERROR, NOTHING = range(7)
#: Share of a response from which clauses of one kind make a defect, and most of a copy that may be answer.
MOST_PART, BESIDES = 0.5, 0.05

#: Words with a grammatical use only, by language.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden wurde wurden nicht auch auf aus bei bis durch für gegen im in ins mit nach nur ob ohne pro seit sich sie sowie statt über um unter vom von vor wenn wer wie zu zum zur als am an je dann dabei hat haben kann können sollte sollten ich mir mich ihr ihre ihren was welche welcher meine mein keine kein dass damit während nachdem obwohl weil sobald falls bevor es wir man",
    "en": "the a an and or but is are was were be been not also on from by until through for against in with after only whether without per since than when who how to of as at that this which it can should have has had more i you your my we does do what much during before because although once if",
    "fr": "le la les un une des du de et ou mais est sont pas aussi sur dans avec après sans par pour plus que qui ce cette il elle vous votre au aux en se",
    "es": "el la los las un una unos unas de del y o pero es son no también en con después sin por para más que se su al lo como",
    "it": "il lo la i gli le un una uno di del della dei delle e o ma è sono non anche su in con dopo senza per più che si al alla come",
}
_FUNCTION = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}
_NAMES = list(_FUNCTION)
#: Words after which a sentence goes on.
_GOES_ON = set("und oder aber sowie weil wenn dass damit ob als wie mit von zu für der die das dem den ein eine einer eines einen and or but because when that with of to for the a an as than is are was".split())

#: Broad cues of clauses that decline. Who speaks or what was given, and a word that denies.
_SPEAKER = re.compile(r"\b(?:ich|mir|mich|i|me|we|wir|kontext\w*|unterlagen|quellen?|kontextes|context|documents?|sources?|sprachmodell|language model|ai|ki)\b", re.I)
_DENIES = re.compile(r"\b(?:nicht|keine[nrms]?|kein|nichts|ablehnen|fehlt|unmöglich|not|no|cannot|can't|can’t|unable|decline|refuse|nothing|won't)\b", re.I)
_ASKS = re.compile(r"\b(?:antwort\w*|beantwort\w*|sagen|auskunft|angaben?|information(?:en)?|frage|anfrage|empfehlung|thema|themen|punkt|dazu|hierzu|grundlage|lage|answer|help|assist|question|advice|information|request|this|cover\w*)\b", re.I)
_SORRY = re.compile(r"\b(?:leider|leid|sorry|bedaure|bedauere|regret|unfortunately|apologi[sz]e|nachsicht|verständnis)\b", re.I)
#: Cues of machine messages and of fields left blank.
_MACHINE = re.compile(r"traceback|exception\b|\berror\b|error:|\w+error\b|timeout|timed out|out of memory|disconnected|cannot connect|connection (?:refused|reset)|internal server|bad gateway|unavailable|not loaded|status[ _]?code|errno|segmentation fault", re.I)
_BLANK = re.compile(r"^\W*(?:n\W?/?\W?a|null|none|nan|nil|undefined|leer|empty|keine antwort|no answer|antwort|answer|response|tbd|todo)\W*$", re.I)
#: How a query is led in when it is handed back, for training.
_LEADS = ("Ihre Frage lautet: ", "Frage: ", "Sie fragen: ", "Die Frage war: ", "Zu Ihrer Frage: ", "Your question: ", "You asked: ", "Question: ")

#: Refusals of a general kind, for training.
_REFUSALS = {
    "de": ("Das kann ich leider nicht beantworten.", "Dazu liegen mir keine Informationen vor.", "Hierzu darf ich keinen Rat geben. Fragen Sie bitte in einer Praxis nach.", "Tut mir leid, dabei kann ich nicht helfen.", "Im Kontext steht dazu nichts."),
    "en": ("I'm sorry, I can't answer that.", "I cannot help with this. Please talk to a doctor.", "I am unable to give advice here.", "Sorry, I can't help you with that question.", "The context says nothing about this."),
}
#: Machine messages of a general kind, for training.
_MESSAGES = (
    "java.lang.IllegalStateException: stream closed at Server.read(Server.java:212)", "HTTP 429 Too Many Requests", '{"status": 500, "message": "unexpected failure"}', "ERROR worker 3 died, exit code 137",
    "requests.exceptions.ReadTimeout: read timed out after 60 s", "panic: runtime error: index out of range [4]", "502 Bad Gateway", "Segmentation fault (core dumped)", "[WARN] upstream closed the connection", "ValueError: max_tokens must be positive",
    "Memory exhausted. Requested 512 MB of 300 MB", "Request failed. Retry in 30 s", "Worker lost. Exit status 9", "Device error. Kernel launch failed on GPU 1",
)
#: What stands for no answer, for training.
_BLANKS = ("n/a", "N/A", "null", "None", "NaN", "undefined", "leer", "empty", "keine Antwort", "no answer", "TBD", "Antwort:", "-", "[]", "{}", "—", "...")
#: Abbreviations at which a sentence may break off, for training.
_SHORT_FORMS = ("z. B.", "d. h.", "ca.", "bzw.", "e.g.", "i.e.")

_MARKUP = re.compile(r"</?[a-zA-Z][^>]*>|&[a-z]+;|&#\d+;")
_INVISIBLE = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\xa0\xad͏؜ ᠎ -‏ -  -⁯　﻿]+")
_CLAUSE = re.compile(r"\n+|(?<=[.!?…])[\"”“»)\]*]*:?\s+(?=\S)")
_ABBREVIATION = re.compile(r"(?:\b(?:z\. ?B|d\. ?h|u\. ?a|bzw|ca|vgl|inkl|evtl|usw|etc|Nr|Dr|Prof|e\. ?g|i\. ?e|[A-Za-z])\.|(?:^|\n)\s*\d+\.)$")
_LIST_ITEM = re.compile(r"^\s*(?:[-•*–]|\d+[.)])\s+\S")
_MARKER = re.compile(r"^\s*(?:[-•*–]|\d+[.)])\s*$")
_SHORT_FORM = re.compile(r"(?:\b(?:z\. ?B|d\. ?h|u\. ?a|e\. ?g|i\. ?e|bzw|vgl|ca)\.?)$")
_SIGN = re.compile(r"[^\w\s]|_")
_CODE = re.compile(r"[_{]|[a-z][A-Z]|\b[A-Z]{4,}\b")
_DIGIT = re.compile(r"\d")
_FINAL = re.compile(r"[.!?…][\"”“»)\]*_]*$")


def clauses(text: str) -> list[str]:
    """Sentences and lines of a text; abbreviations and list numbers do not end a clause."""
    out: list[str] = []
    at = 0
    for cut in _CLAUSE.finditer(text):
        part = text[at : cut.start()]
        if "\n" not in cut.group() and _ABBREVIATION.search(part):
            continue
        part = text[at : cut.end()].strip()
        if part:
            out.append(part)
        at = cut.end()
    if text[at:].strip():
        out.append(text[at:].strip())
    return out


def visible(text: str | None) -> str:
    """A text without mark-up and invisible characters."""
    text = text or ""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _INVISIBLE.sub(" ", text).strip()


def _along(words: list[str], asked: list[str]) -> int:
    """Length of the longest common subsequence of a clause and the query."""
    row = [0] * (len(asked) + 1)
    for w in words:
        before = 0
        for j, a in enumerate(asked, 1):
            keep = row[j]
            row[j] = before + 1 if w == a else max(row[j], row[j - 1])
            before = keep
    return row[-1]


def _end(clause: str) -> str:
    """How a clause ends."""
    if _MARKER.match(clause):
        return "marker"
    if _SHORT_FORM.search(clause):
        return "short form"
    if _FINAL.search(clause):
        return "final"
    last = clause[-1]
    if last.isalpha():
        return "letter"
    if last.isdigit():
        return "digit"
    return {")": "bracket", "]": "bracket", "}": "brace", ":": "colon", ",": "comma", ";": "comma", "-": "dash", "–": "dash", "—": "dash", "(": "open", "„": "open", "[": "open"}.get(last, "quote" if last in "”“»\"'" else "sign")


class Languages:
    """Letter trigrams of the languages that the corpus asks in, learned from words of clauses with function words of just
    one of them."""

    def __init__(self, texts: list[str]):
        seen: dict[str, set] = {lang: set() for lang in _FUNCTION}
        kept = [x for text in texts for x in _spoken_in(text)]
        for lang, words in kept:
            seen[lang].update(words)
        self._set({lang: _grams(words) for lang, words in seen.items() if len(words) >= LEAST_WORDS})
        for lang in self.tables:
            own = [self.score(lang, words) for name, words in kept if name == lang and len(words) > 3]
            self.usual[lang] = _usual(len(own), float(np.sum(own)), float(np.sum(np.square(own))))

    def _set(self, tables: dict[str, tuple[dict, dict]]) -> Languages:
        self.tables, self.usual, self.words = tables, {}, {}
        return self

    @classmethod
    def of_counts(cls, tables: dict[str, tuple[dict, dict]]) -> Languages:
        """Of trigrams and bigrams that were counted before."""
        return cls([])._set(tables)

    def _letters(self, lang: str, word: str) -> float:
        three, two = self.tables[lang]
        padded = f"^{word}$"
        return float(sum(np.log((three.get(padded[i : i + 3], 0) + 0.1) / (two.get(padded[i : i + 2], 0) + 4.0)) for i in range(len(padded) - 2)))

    def word(self, word: str) -> tuple:
        """Letters of a word (none of a number), the languages it is a function word of, and its log-likelihood by language."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            spoken = not word.isdigit()
            function = tuple(word in own for own in _FUNCTION.values())
            got = self.words[word] = len(word) if spoken else 0, function if any(function) else None, tuple(self._letters(lang, word) for lang in self.tables) if spoken else None
        return got

    def sums(self, words: list[str]) -> tuple[int, int, list[int], list[float]]:
        """Spoken words, their letters, function words by language, and log-likelihood of all letters by language."""
        spoken = letters = 0
        function, total = [0] * len(_FUNCTION), [0.0] * len(self.tables)
        for word in words:
            n, grammatical, likely = self.words.get(word) or self.word(word)
            if n:
                spoken += 1
                letters += n
                for k, x in enumerate(likely):
                    total[k] += x
                if grammatical:
                    for k, yes in enumerate(grammatical):
                        function[k] += yes
        return spoken, letters, function, total

    def score(self, lang: str, words: list[str]) -> float:
        """Mean log-likelihood of the letters of some words."""
        _, letters, _, total = self.sums(words)
        return total[list(self.tables).index(lang)] / letters if letters else 0.0

    def of(self, words: list[str]) -> str | None:
        """The language of some words: by function words, else by letters if they are usual in it."""
        found = by_function_words(words)
        if found or not words:
            return found
        best = max(self.tables, key=lambda x: self.score(x, words), default=None)
        return best if best and self.score(best, words) >= self.usual[best][0] - 3 * self.usual[best][1] else None


#: Distinct words of a language from which its letters are counted.
LEAST_WORDS = 10


def _spoken_in(text: str | None) -> list[tuple[str, list[str]]]:
    """Language and words of each clause of a text with function words of one language above all."""
    words = [[w.casefold() for w in WORD.findall(c)] for c in clauses(visible(text))]
    return [(lang, own) for own in words if (lang := by_function_words(own))]


def _grams(words: set[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Counts of the trigrams of some words, and of the bigrams that they begin with."""
    three: Counter = Counter()
    two: Counter = Counter()
    for word in words:
        padded = f"^{word}$"
        three.update(padded[i : i + 3] for i in range(len(padded) - 2))
        two.update(padded[i : i + 2] for i in range(len(padded) - 2))
    return dict(three), dict(two)


def _usual(n: int, total: float, squares: float) -> tuple[float, float]:
    """Mean and spread of the scores of clauses in their own language."""
    return (total / n, max(max(squares / n - (total / n) ** 2, 0.0) ** 0.5, 0.08)) if n else (-2.2, 0.3)


def by_function_words(words: list[str]) -> str | None:
    """The language that leads by function words, None without a lead."""
    counts = sorted(((sum(w in own for w in words), lang) for lang, own in _FUNCTION.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else None


class _Numbers(dict):
    """Numbers of features: words and pairs of words as they are, other features with a name that holds a blank."""

    def __missing__(self, feature: str | tuple) -> int:
        text = feature if isinstance(feature, str) else "\0".join(map(str, feature))
        value = self[feature] = zlib.crc32(text.encode("utf-8", "surrogatepass")) % HASHED
        return value


def _step(value: float, *bounds: float) -> int:
    return bisect_right(bounds, value)


class Reader:
    """Turns a pair into clauses, their weights and their features."""

    def __init__(self, languages: Languages, vocabulary: set[str]):
        self.languages, self.vocabulary, self.number = languages, vocabulary, _Numbers()
        self.asked: dict[str, tuple[list[str], set[str], str | None]] = {}

    def query(self, query: str | None) -> tuple[list[str], set[str], str | None]:
        got = self.asked.get(query or "")
        if got is None:
            if len(self.asked) > 20_000:
                self.asked.clear()
            words = [w.casefold() for w in WORD.findall(query or "")]
            got = self.asked[query or ""] = words, set(words), self.languages.of(words)
        return got

    def read(self, query: str | None, answer: str | None) -> tuple[list[str], list[list[int]]]:
        if len(self.number) > REMEMBERED:
            self.number.clear()
        asked, known, language = self.query(query)
        found = clauses(visible(answer))
        rows = []
        items = sum(bool(_LIST_ITEM.match(c)) for c in found)
        for i, clause in enumerate(found):
            rows.append(self._features(clause, i, found, asked, known, language, items))
        return found, rows

    def _features(self, clause: str, i: int, found: list[str], asked: list[str], known: set[str], language: str | None, items: int) -> list[int]:
        words = [w.casefold() for w in WORD.findall(clause)]
        last, n = i == len(found) - 1, len(words)
        size = _step(n, 1, 2, 4, 7)
        out = [" ", (" size", size), (" place", min(i, 2), last), (" clauses", min(len(found), 4))]
        shared = 0
        if n and asked and len(known.intersection(words)) >= 0.3 * len(set(words)):
            if n > 4 * len(asked) + 20:
                # far beyond the query, order makes no difference
                shared = sum(w in known for w in words)
            else:
                shared = max(_along(words, asked), _along(words, asked + asked) if n > len(asked) else 0)
        share = shared / max(n, 1)
        echo = _step(share, 0.25, 0.5, 0.67, 0.8, 0.9, 1.0)
        covered = _step(shared / max(len(asked), 1), 0.3, 0.6, 0.8, 0.95)
        out += [(" along", echo, size > 1), (" covers", covered), (" along", echo, "covers", covered)]
        spoken, letters, function, total = self.languages.sums(words)
        if language and spoken:
            at = _NAMES.index(language)
            own = function[at] / spoken
            other = max(n for k, n in enumerate(function) if k != at) / spoken
            long = _step(spoken, 3, 6)
            out += [(" own", _step(own, 0.001, 0.1, 0.2), long), (" other", _step(other - own, -0.1, 0.05, 0.15, 0.3), long)]
            if language in self.languages.tables:
                mean, spread = self.languages.usual[language]
                likely = {lang: x / letters for lang, x in zip(self.languages.tables, total)}
                here = likely.pop(language)
                rival = max(likely.values(), default=here - 1)
                usual, ahead = _step((here - mean) / spread, -6, -4, -3, -2, -1), _step(here - rival, -0.5, -0.25, -0.1, 0, 0.1, 0.25)
                out += [(" usual", usual, long), (" ahead", ahead, long)]
        else:
            out.append("no language" if spoken else "no words")
        if last:
            end, item = _end(clause), bool(_LIST_ITEM.match(clause))
            listed = item and items > 1
            final = words[-1] if words else ""
            heard = final in self.vocabulary
            out += [(" end", end), (" end", end, listed, size), (" end", end, listed, heard)]
            out += [(" end", end, "open", final in _GOES_ON, listed), (" end", end, "along", echo, covered, final in asked[-1:])]
            if any(clause.count(a) != clause.count(b) for a, b in ("()", "[]", "„“")) or clause.count("**") % 2:
                out.append((" end", end, "unbalanced"))
        signs = len(_SIGN.findall(clause))
        out += [(" signs", _step(signs / len(clause), 0.04, 0.08, 0.15)), (" first", clause[0] if not clause[0].isalnum() else clause[0].isupper())]
        if _CODE.search(clause):
            out.append("a code")
        if _DIGIT.search(clause):
            out.append("a digit")
        if clause.rstrip("”“»\"' ").endswith("?"):
            out.append("a question")
        number = self.number
        return [number[x] for x in chain(out, set(words))]


def cued(query: list[str], found: list[str]) -> list[int]:
    """Tags of the clauses of a response of the corpus by broad cues, for training."""
    out: list[int] = []
    asked = set(query)
    own = by_function_words(query)
    worded = [[w.casefold() for w in WORD.findall(c)] for c in found]
    whole = [w for words in worded for w in words]
    strange = own and len(whole) > 7 and sum(w in _FUNCTION[own] for w in whole) < 0.08 * len(whole)
    for i, (clause, words) in enumerate(zip(found, worded)):
        shared = sum(w in asked for w in words) / max(len(words), 1)
        declines = _SPEAKER.search(clause) and _DENIES.search(clause) and _ASKS.search(clause) and not any(c.isdigit() for c in clause)
        if not words or len(found) == 1 and _BLANK.match(clause):
            tag = NOTHING
        elif shared < 0.3 and (_MACHINE.search(clause) or out and out[-1] == ERROR and sum(w in _FUNCTION.get(own, ()) for w in words) < 0.25 * len(words)):
            tag = ERROR
        elif shared >= 0.85 and len(words) >= 3 or len(asked) > 3 and len(words) <= len(query) + 5 and _along(words, query) >= 0.9 * len(query):
            broken = i == len(found) - 1 and _end(clause) in ("letter", "digit", "comma", "colon") and words[-1] != query[-1]
            tag = UNFINISHED if broken else ECHO
        elif declines or _SORRY.search(clause) and _DENIES.search(clause) and _ASKS.search(clause) or out and out[-1] == REFUSAL and _brief(found[i:], worded[i:]):
            tag = REFUSAL
        elif own and len(words) > 4 and (strange or (by_function_words(words) or own) != own):
            tag = FOREIGN
        elif i == len(found) - 1 and (_end(clause) in ("marker", "short form", "colon", "comma", "dash", "open") or _end(clause) in ("letter", "digit") and not _LIST_ITEM.match(clause)):
            tag = UNFINISHED
        else:
            tag = ANSWER
        out.append(tag)
    return out


def _brief(rest: list[str], worded: list[list[str]]) -> bool:
    """Whether what follows a refusal belongs to it: few words, and no quantity."""
    return sum(map(len, worded)) <= 30 and not any(c.isdigit() for x in rest for c in x)


def _made_up(text: str, rng: np.random.Generator) -> str:
    """A text in letters exchanged at random, vowels for vowels: a language that nobody speaks."""
    groups = ("aeiouäöü", "bcdfghjklmnpqrstvwxzß")
    table = {}
    for group in groups:
        for a, b in zip(group, rng.permutation(list(group))):
            table[ord(a)], table[ord(a.upper()[0])] = b, b.upper()[0]
    return text.translate(table)


def _examples(rows: list[tuple], rng: np.random.Generator) -> list[tuple[str, str, list[int]]]:
    """``(query, answer, tags)`` made of sound responses: broken off, handed back, in another language or letters,
    behind a refusal of a general kind or in place of one, replaced by a machine message or a blank, or reduced to a few
    words."""
    sound = []
    for query, answer in rows:
        words = [w.casefold() for w in WORD.findall(query or "")]
        found = clauses(visible(answer))
        if words and 0 < len(found) <= TRAINED and set(cued(words, found)) == {ANSWER}:
            sound.append((query, found, by_function_words(words)))
    by_language: dict[str | None, list] = {}
    for query, found, lang in sound:
        by_language.setdefault(lang, []).append(found)
    out: list[tuple[str, str, list[int]]] = []
    every = len(sound)
    for k in range(max(every, MADE) if every else 0):
        query, found, lang = sound[k % every]
        text = " ".join(found[:-1] + [""]) if k % 3 else "\n".join(found[:-1] + [""])
        kind = k % 10 if every >= 10 else int(rng.integers(10))
        if kind < 4:
            cut = found[-1]
            at = int(rng.integers(max(len(cut) // 4, 1), max(len(cut) - 1, 2)))
            cut = cut[:at].rstrip() if kind < 2 else " ".join(cut.split()[: max(1, int(rng.integers(1, len(cut.split()) + 1)) - 1)])
            if kind == 1 and rng.random() < 0.3:
                cut = found[-1] + "\n" + ["-", "2.", "1.", "•"][int(rng.integers(4))]
            elif kind == 3 and rng.random() < 0.15:
                cut = found[-1].rstrip(".!?") + ":"
            elif kind == 3 and rng.random() < 0.2:
                cut += " " + _SHORT_FORMS[int(rng.integers(len(_SHORT_FORMS)))]
            if kind == 2 and rng.random() < 0.2:
                half = query.split()[: -max(1, len(query.split()) // 4)]
                text, cut = "", " ".join(half)
                parts = clauses(visible(cut))
                if len(half) > 2 and _end(parts[-1]) == "letter":
                    out.append((query, cut, [ECHO] * (len(parts) - 1) + [UNFINISHED]))
                continue
            broken = clauses(visible(text + cut))
            if broken and _end(broken[-1]) not in ("final", "bracket", "quote", "sign"):
                out.append((query, text + cut, [ANSWER] * (len(broken) - 1) + [UNFINISHED]))
        elif kind < 7:
            back = query
            style = int(rng.integers(8))
            if style == 1:
                back = query.upper()
            elif style == 2:
                back = query.lower()
            elif style == 3:
                back = f"„{query}“"
            elif style == 4:
                back = query.rstrip("?") + "."
            elif style == 5:
                drop = query.split()
                back = " ".join(drop[: len(drop) // 2] + drop[len(drop) // 2 + 1 :])
            elif style == 6:
                back = f"{query} {query}"
            elif style == 7:
                back = query.rstrip("?")
            if rng.random() < 0.3:
                back = _LEADS[int(rng.integers(len(_LEADS)))] + back
            n = len(clauses(visible(back)))
            if kind == 6 and _FINAL.search(back):
                out.append((query, back + " " + " ".join(found), [ECHO] * n + [ANSWER] * len(found)))
            else:
                out.append((query, back, [ECHO] * n))
        elif kind < 9:
            others = [x for name, rest in by_language.items() if name != lang and name for x in rest]
            if kind == 8 or not others or not lang:
                other = clauses(_made_up(" ".join(found), rng))
            else:
                other = others[int(rng.integers(len(others)))]
            kept = found[: len(other) // 2] if rng.random() < 0.25 else []
            answer = " ".join(kept + other)
            tags = [ANSWER] * len(kept) + [FOREIGN] * len(other)
            out.append((query, answer, tags if len(clauses(answer)) == len(tags) else []))
        elif lang in _REFUSALS and rng.random() < 0.5:
            declined = _REFUSALS[lang][int(rng.integers(len(_REFUSALS[lang])))]
            n = len(clauses(declined))
            kept = found if rng.random() < 0.3 else []
            out.append((query, " ".join([declined, *kept]), [REFUSAL] * n + [ANSWER] * len(kept)))
        elif rng.random() < 0.5:
            message, tag = (_MESSAGES, ERROR) if rng.random() < 0.6 else (_BLANKS, NOTHING)
            said = message[int(rng.integers(len(message)))]
            out.append((query, said, [tag] * len(clauses(said))))
        else:
            short = found[-1].split()
            start = int(rng.integers(max(1, len(short) - 5)))
            part = " ".join(short[start : start + int(rng.integers(1, 6))]).rstrip(",;:-–(") + "."
            out.append((query, part, [ANSWER] * len(clauses(visible(part)))))
    return [x for x in out if x[2]]


class ClauseField:
    """A linear-chain conditional random field over clause tags, trained by stochastic gradient on the log-likelihood."""

    def __init__(self) -> None:
        self.w = np.zeros((HASHED, len(TAGS)))
        self.t = np.zeros((len(TAGS), len(TAGS)))
        self.squares, self.t_squares, self.order = np.full(self.w.shape, 1e-3), np.full(self.t.shape, 1e-3), np.random.default_rng(7)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """The scores of the tags of many clauses, in one pass."""
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(self.w[flat], starts, axis=0)

    def _padded(self, rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by response and place, the place of each clause in them, and the lengths of the responses."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        scored = np.zeros((len(rows), int(lengths.max()), len(TAGS)))
        where = np.arange(scored.shape[1])[None, :] < lengths[:, None]
        scored[where] = self.scores([r for response in rows for r in response])
        return scored, where, lengths

    def train(self, data: list[tuple[list[list[int]], list[int]]], passes: int = PASSES) -> ClauseField:
        """Steps over groups of responses of like length; each weight has its own falling step."""
        order, squares, t_squares = self.order, self.squares, self.t_squares
        by_length = sorted(range(len(data)), key=lambda k: len(data[k][0]))
        groups = [by_length[at : at + STEP_ROWS] for at in range(0, len(by_length), STEP_ROWS)]
        for _ in range(passes):
            for g in order.permutation(len(groups)):
                rows, tags = zip(*(data[k] for k in groups[g]))
                scored, where, lengths = self._padded(list(rows))
                wanted = np.zeros(scored.shape)
                wanted[where] = np.eye(len(TAGS))[[t for r in tags for t in r]]
                marginal, moves = self._expected(scored, where, lengths)
                error = (wanted - marginal)[where]
                flat = np.array([x for response in rows for r in response for x in r], np.int64)
                owner = np.repeat(np.arange(len(error)), [len(r) for response in rows for r in response])
                touched, at = np.unique(flat, return_inverse=True)
                gradient = np.stack([np.bincount(at, error[owner, k], len(touched)) for k in range(len(TAGS))], 1) - PULL * len(rows) * self.w[touched]
                squares[touched] += gradient**2
                self.w[touched] += STEP * gradient / np.sqrt(squares[touched])
                seen = np.einsum("nia,nib->ab", wanted[:, :-1], wanted[:, 1:])
                gradient = seen - moves
                t_squares += gradient**2
                self.t += STEP * gradient / np.sqrt(t_squares)
        return self

    def _expected(self, scored: np.ndarray, where: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the tags of each clause, and expected numbers of each move between tags."""
        n, longest, _ = scored.shape
        forward, backward = np.zeros(scored.shape), np.zeros(scored.shape)
        forward[:, 0] = scored[:, 0]
        for i in range(1, longest):
            forward[:, i] = scored[:, i] + _lse(forward[:, i - 1, :, None] + self.t, 1)
        for i in range(longest - 2, -1, -1):
            step = _lse(self.t + (scored[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(where[:, i + 1, None], step, 0.0)
        total = _lse(forward[np.arange(n), lengths - 1], 1)
        marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0.0))
        moves = np.zeros(self.t.shape)
        for i in range(1, longest):
            on = where[:, i]
            pair = forward[on, i - 1, :, None] + self.t + (scored[on, i] + backward[on, i])[:, None, :] - total[on, None, None]
            moves += np.exp(np.minimum(pair, 0.0)).sum(0)
        return marginal, moves

    def tag(self, responses: list[list[list[int]]]) -> list[list[int]]:
        """The likeliest tags of the clauses of many responses (Viterbi, over all of them at once)."""
        out: list[list[int]] = [[] for _ in responses]
        by_length = sorted((k for k, r in enumerate(responses) if r), key=lambda k: len(responses[k]))
        at = 0
        while at < len(by_length):
            group = by_length[at : at + 1024]
            # responses of like length only, so that one long one costs the others nothing
            group = [k for k in group if len(responses[k]) <= 2 * len(responses[group[0]]) + 4]
            at += len(group)
            scored, _, lengths = self._padded([responses[k] for k in group])
            score, back = [scored[:, 0]], []
            for i in range(1, scored.shape[1]):
                reach = score[-1][:, :, None] + self.t
                back.append(reach.argmax(1))
                score.append(scored[:, i] + reach.max(1))
            for n, k in enumerate(group):
                tag = int(score[lengths[n] - 1][n].argmax())
                tags = [tag]
                for i in range(int(lengths[n]) - 2, -1, -1):
                    tag = int(back[i][n, tag])
                    tags.append(tag)
                out[k] = tags[::-1]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def defect_of(weights: list[int], tags: list[int]) -> str | None:
    """The defect of a pair by what the tags of its clauses cover, None if it is sound. A message that breaks off is a message."""
    covered = [0] * len(TAGS)
    for w, t in zip(weights, tags):
        covered[t] += w
    total = sum(covered) - covered[NOTHING]
    if not total:
        return "empty"
    share = [x / total for x in covered]
    if share[ERROR] and share[ERROR] + share[UNFINISHED] >= MOST_PART:
        return "error"
    if share[REFUSAL] >= MOST_PART:
        return "refusal"
    if share[ECHO] and share[ECHO] >= 1 - BESIDES - share[REFUSAL] - share[ERROR]:
        return "copy"
    if share[FOREIGN] > MOST_PART:
        return "language"
    if tags[-1] == UNFINISHED:
        return "truncated"
    return None


class PairJudge:
    """The fitted field with its reader."""

    def __init__(self, reader: Reader, field: ClauseField):
        self.reader, self.field = reader, field

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The defect of each pair; equal pairs are judged once."""
        distinct = list(dict.fromkeys(pairs))
        read = [self.reader.read(*p) for p in distinct]
        tags = self.field.tag([rows for _, rows in read])
        known = {p: defect_of([len(c) for c in found], t) for p, (found, _), t in zip(distinct, read, tags)}
        return [known[p] for p in pairs]


def trained(rows: list[tuple[str | None, str | None]]) -> PairJudge:
    """The field of some pairs, of which every response with few clauses is used, with the examples made of them."""
    languages = Languages([x for row in rows for x in row if x])
    words = Counter(w for a in dict.fromkeys(a for _, a in rows if a) for w in {w.casefold() for w in WORD.findall(a)})
    reader = Reader(languages, {w for w, n in words.items() if n > 1})
    return PairJudge(reader, _light(ClauseField().train(_lessons(reader, rows, np.random.default_rng(7)))))


def _lessons(reader: Reader, rows: list[tuple[str | None, str | None]], rng: np.random.Generator) -> list[tuple[list[list[int]], list[int]]]:
    """Features and tags of the clauses of some pairs and of the examples made of them."""
    data = []
    for query, answer in rows:
        found, features = reader.read(query, answer)
        if 0 < len(found) <= TRAINED:
            tags = cued(reader.query(query)[0], found)
            data += [(features, tags)] * (RARE if REFUSAL in tags or ERROR in tags else 1)
    for query, answer, tags in _examples(rows, rng):
        found, features = reader.read(query, answer)
        if len(found) == len(tags):
            data.append((features, tags))
    return data


def _light(field: ClauseField) -> ClauseField:
    """A field without what only training needs."""
    del field.squares, field.t_squares
    return field


def fitted(results: DataFrame) -> PairJudge:
    """The field, trained on all distinct pairs."""
    answered = staged(results.where("answer is not null").select("query", "answer").distinct())
    n = answered.count()
    if n <= FEW:
        return trained(sorted(map(tuple, answered.collect()), key=str))
    reader = _counted_reader(answered)
    return PairJudge(reader, _averaged(answered, reader, -(-n // SHARD)))


def _counted_reader(answered: DataFrame) -> Reader:
    """Letters of the languages and words of the answers, counted over all distinct texts."""
    context = answered.sparkSession.sparkContext
    texts = answered.select(F.col("answer").alias("text")).distinct().withColumn("answers", F.lit(True))
    answers = texts.count()
    texts = spread(staged(texts.unionByName(answered.where("query is not null").select(F.col("query").alias("text")).distinct().withColumn("answers", F.lit(False)))))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for text, answer in zip(batch["text"], batch["answers"]):
                if answer:
                    n.update(("", w) for w in {w.casefold() for w in WORD.findall(text)})
                n.update({(lang, w) for lang, own in _spoken_in(text) for w in own})
            yield pd.DataFrame([(lang, w, k) for (lang, w), k in n.items()], columns=["lang", "word", "n"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                for size, table in zip((3, 2), _grams(set(own["word"]))):
                    yield pd.DataFrame({"lang": lang, "size": size, "gram": list(table), "n": list(table.values())})

    known = staged(texts.mapInPandas(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    heard = {r["word"] for r in known.where((F.col("lang") == "") & (F.col("n") > max(1.0, HEARD * answers))).select("word").collect()}
    spoken = {r["lang"] for r in known.where("lang <> ''").groupBy("lang").count().where(F.col("count") >= LEAST_WORDS).collect()}
    tables: dict[str, tuple[dict, dict]] = {lang: ({}, {}) for lang in _FUNCTION if lang in spoken}
    for lang, size, gram, n in known.where("lang <> ''").select("lang", "word").mapInPandas(grams, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n")).collect():
        if lang in tables:
            tables[lang][3 - size][gram] = n
    languages = Languages.of_counts(tables)
    shared = context.broadcast(languages)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = [(lang, own.score(lang, words)) for text in batch["text"] for lang, words in _spoken_in(text) if lang in own.tables and len(words) > 3]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    seen = texts.select("text").mapInPandas(scored, "lang string, score double").groupBy("lang").agg(F.count("*"), F.sum("score"), F.sum(F.col("score") * F.col("score"))).collect()
    languages.usual = {lang: _usual(0, 0.0, 0.0) for lang in tables} | {lang: _usual(*sums) for lang, *sums in seen}
    languages.words = {}
    return Reader(languages, heard)


def _averaged(answered: DataFrame, reader: Reader, shards: int) -> ClauseField:
    """The field of all pairs: each shard trains one on its pairs, in steps through them; a weight is the mean over the shards that
    have seen its feature, by how often they have. The shards, and with them the field, depend on the pairs only."""
    shared = answered.sparkSession.sparkContext.broadcast(reader)
    width = len(TAGS) + 1

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, own, rng, seen, rows, passes, shard = ClauseField(), shared.value, np.random.default_rng(7), np.zeros(HASHED), [], PASSES, 0

        def learn() -> None:
            nonlocal passes
            data = _lessons(own, rows, rng)
            rows.clear()
            if data:
                np.add.at(seen, np.fromiter((x for response, _ in data for r in response for x in r), np.int64), 1)
                field.train(data, passes)
                passes = 1

        for batch in batches:
            for shard, query, answer in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((query, answer))
                if len(rows) >= FEW:
                    learn()
        if rows:
            learn()
        if seen.any():
            total = np.concatenate([field.w * seen[:, None], seen[:, None]], 1).reshape(SLICES, -1)
            moves = np.append(field.t.ravel(), 1.0) * seen.max()
            yield pa.RecordBatch.from_arrays([pa.array([shard] * (SLICES + 1), pa.int32()), pa.array(range(SLICES + 1), pa.int32()), pa.array([x.tobytes() for x in [*total, moves]], pa.binary())], names=["shard", "slice", "sums"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    dealt = answered.withColumn("shard", F.pmod(F.xxhash64("query", "answer"), F.lit(shards)).cast("int")).select("shard", "query", "answer")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("query", "answer")
    sums = dealt.mapInArrow(train, "shard int, slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()
    held = {at: np.frombuffer(x) for at, x in sums}
    field = _light(ClauseField())
    if held:
        table = np.concatenate([held[k] for k in range(SLICES)]).reshape(HASHED, width)
        field.w = table[:, :-1] / np.maximum(table[:, -1:], 1.0)
        field.t = (held[SLICES][:-1] / held[SLICES][-1]).reshape(field.t.shape)
    return field


def pair_defects(results: DataFrame) -> DataFrame:
    """``query_id, defect`` of every defective pair: empty, truncated, refusal, copy, language or error.

    A narrow map after training; re-delivered pairs count once, and the shuffle for that carries two short columns. Null and
    blank responses are empty; a null query has no language and cannot be copied. Extra columns are ignored; an empty table
    gives an empty result.
    """
    shared = results.sparkSession.sparkContext.broadcast(fitted(results))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value
        for batch in batches:
            found = judge.defects(list(zip(batch["query"], batch["answer"])))
            yield pd.DataFrame({"query_id": batch["query_id"], "defect": found}).dropna(subset=["defect"])

    return spread(results.select("query_id", "query", "answer")).mapInPandas(find, "query_id bigint, defect string").distinct()
