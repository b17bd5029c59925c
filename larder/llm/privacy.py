"""Personal details inside free text.

Method: weak-supervision aggregation. Patterns propose spans; labelers (format, words before, words behind, gazetteer, shape
of the surroundings) vote for, against or not at all; expectation-maximisation over the counts of all vote patterns in the
corpus estimates how reliable each labeler is; and a logistic classifier trained on the resulting probabilities decides
each span. The name gazetteer is learned from the corpus itself: words that strong cues introduce in several documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.staging import staged
from larder.sources.tables import spread

#: Documents in which a strong cue must introduce a word before it counts as a known name.
KNOWN_IN = 3
#: Rounds of expectation-maximisation, steps of the classifier, probability from which a span is a detail.
ROUNDS, STEPS, ACCEPT = 40, 400, 0.5
LABELERS = 5
KINDS = ("email", "phone", "id_number", "address", "name")
#: What stands for a detail of each kind.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_S = r"[^\S\n\r]"
# ---------------------------------------------------------------- email
_AT = rf"(?:{_S}*(?:@|\(at\)|\[at\]|\{{at\}}|<at>|\(ät\)|\[ät\]|\(@\)){_S}*|{_S}+at{_S}+)"
_DOT = rf"(?:\.|{_S}*(?:\(punkt\)|\[punkt\]|\(dot\)|\[dot\]|\(\.\)|\[\.\]){_S}*|{_S}+(?:punkt|dot){_S}+)"
_EMAIL = re.compile(rf"(?<![\w.+@-])(?P<local>[\w+-]+(?:\.[\w+-]+)*)(?P<at>{_AT})(?P<domain>[a-z0-9äöü][a-z0-9äöü-]*(?:{_DOT}[a-z0-9äöü][a-z0-9äöü-]*)*{_DOT}[a-z]{{2,}})(?![\w@-])", re.I)
_MAY_EMAIL = re.compile(r"@|[(\[{<](?:at|ät)[)\]}>]|\bat\b", re.I)
# ---------------------------------------------------------------- phone
_PHONE = re.compile(rf"(?<![\w.,/:+-])(?:\+|\()?\d(?:\(0\)|(?:{_S}?[/–-]{_S}?|\.|{_S})?(?:[()]{_S}?)?\d){{6,16}}(?![\w])(?![.,-]\d)")
_MAY_PHONE = re.compile(r"[+(]?\d[\d \t\xa0\u2000-\u200a\u202f()/.–-]{5,}\d")
_PHONE_SHAPES = re.compile(r"^(?:\+\d|00[1-9]\d|\(0\d{1,4}\)|0[1-9]\d{1,4}[ /.–-]|01[567]\d|0[1-9]\d{6,}$|\(\d{3}\) ?\d{3}[-. ]\d{4}$|\d{3}[.-]\d{3}[.-]\d{4}$)")
_DATE = re.compile(r"^\d{1,2}\.\d{1,2}\.\d{2,4}$|^\d{4}-\d{2}-\d{2}$")
_PHONE_BEFORE = re.compile(r"(?:\btel(?:efon)?\b\.?|\bmobil\b|\bhandy\b|\bfax\b|durchwahl|\bphone\b|call me|ruft mich|anruf|rufnummer|\bcell\b|\bunter|\bon|\bring|\bdial|;)\W{0,3}(?:ist\b|is\b)?\W*$", re.I)
_PHONE_BEHIND = re.compile(r"^\s*(?:oder per|or (?:write|by)|\(\w|\)|\.?$|\.?\s*\n)", re.I)
# ---------------------------------------------------------------- identity, tax, social and health insurance numbers
_ID_LABEL = (
    r"(?:steuer-?(?:id\b|identifikationsnummer|nummer|nr\.?)|idnr\.?|sv-nr\.?|sozialversicherungs(?:nummer|-nr\.?)|rentenversicherungs(?:nummer|-nr\.?)|rv-nr\.?|kv-nr\.?|krankenversicherten\w*|versicherten(?:nummer|-?nr\.?)|versicherungs(?:nummer|-?nr\.?)|"
    r"(?:personal)?ausweis(?:nummer|-?nr\.?)?|(?:reise)?pass(?:nummer|-?nr\.?)?|\bssn|social security (?:number|no\.?)|\bni (?:no\.?|number)|national insurance (?:number|no\.?)|passport(?: number| no\.?)?|nhs (?:number|no\.?)|tax (?:id|number|no\.?)|id card(?: number| no\.?)?)"
)
_ID = re.compile(
    rf"(?<![\w.,/:+-])(?:[1-9]\d{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}}|\d{{2}}{_S}?\d{{6}}{_S}?[A-Z]{_S}?\d{{3}}|[A-Z]{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}}|[A-Z]{{2}}\d{{4}}[A-Z]\d{{3}}|[A-Z]\d[A-Z]\d{{2}}[A-Z]{{2}}\d{{2}}|\d{{3}}-\d{{2}}-\d{{4}}|[A-Z]{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[A-D])(?![\w])(?![.,/-]\d)"
)
_ID_LABELLED = re.compile(rf"{_ID_LABEL}(?:{_S}*(?:lautet|ist|is|:|#)){{0,2}}\s*(?P<n>(?=(?:[A-Z0-9/-]*\d){{5}})[A-Z0-9](?:[A-Z0-9/-]|{_S}(?=\d)){{5,20}}[A-Z0-9])(?!\w)", re.I)
_ID_BEFORE = re.compile(rf"{_ID_LABEL}(?:\s*(?:lautet|ist|is|:|#)){{0,2}}\s*$", re.I)
_ID_BEHIND = re.compile(rf"^\s*(?:abgelegt\s*|filed\s*|\w+\s+)?\(?\s*{_ID_LABEL}", re.I)
_NO_DETAIL = re.compile(r"(?:\bart(?:ikel)?\.?-?nr\.?|bestell\w*|\bcharge|\blos|\bstudie\w*|\bversion|\bband|\bseiten?|\bdoi|\bisbn|\bean|\btabelle|\bkapitel|\bbatch|\blot|\bstudy|\bvol(?:ume)?|\bpages?|\bitem|\border|\bart\.? no\.?)\W*(?:nr\.?|no\.?)?\W*[\w./–-]{0,14}[, ]*$", re.I)
# ---------------------------------------------------------------- address
_WORD = r"[A-ZÄÖÜ][a-zäöüßéè]+"
_STREET_END = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|markt|damm|steig|stieg|graben|hof|chaussee|pfad|winkel|berg|tor|brücke|park|zeile|kamp|bogen|promenade|wall|garten|gärten|anger|aue)"
_STREET = rf"(?:[A-ZÄÖÜ][a-zäöüß-]*{_STREET_END}|{_WORD}(?:er|sche)?[ -](?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Ufer|Markt|Damm|Steig|Chaussee)|(?:Am|An der|An den|An dem|Auf der|Auf dem|Auf den|Im|In der|In den|Unter den|Unter der|Zum|Zur|Zu den|Hinter der|Hinter dem|Vor dem|Vor der|Bei der|Beim)(?:\s{_WORD}){{1,2}})"
_HOUSE = rf"\d{{1,4}}(?:[a-z]\b|{_S}[a-fh-kn-z]\b)?(?:{_S}?[-–]{_S}?\d{{1,4}}(?:[a-z]\b|{_S}[a-fh-kn-z]\b)?)?"
_TOWN = rf"{_WORD}(?:[ -](?:am|an der|bei|im|ob der|in der|auf|unter)\s{_WORD})?"
_DE_ADDRESS = re.compile(rf"(?<![\wäöüß-])(?P<street>{_STREET})\s(?P<house>{_HOUSE})(?![\w-]|[.,]\d)(?P<place>(?:\s*,\s*|\s+in\s+|\s+)(?:D-)?\d{{5}}\s{_TOWN})?")
_HOUSE_AT = re.compile(r"(?<=\s)\d{1,4}(?![\d.,]\d)")
_STREET_UP_TO = re.compile(rf"(?<![\wäöüß-]){_STREET}\s$")
_EN_STREETS = ("Road", "Rd", "Street", "St.", "Close", "Lane", "Avenue", "Ave", "Way", "Drive", "Court", "Place", "Square", "Terrace", "Gardens", "Crescent", "Grove", "Hill", "Row", "Mews")
_EN_ADDRESS = re.compile(rf"(?<![\w-])\d{{1,4}}[a-z]?\s{_WORD}(?:\s{_WORD}){{0,2}}\s(?:Road|Rd\.?|Street|St\.?|Close|Lane|Avenue|Ave\.?|Way|Drive|Court|Place|Square|Terrace|Gardens|Crescent|Grove|Hill|Row|Mews)\b(?P<place>,?\s{_WORD}(?:[\s-]{_WORD}){{0,3}},?\s(?:[A-Z]{{1,2}}\d[\dA-Z]?\s?\d[A-Z]{{2}}|(?:[A-Z]{{2}}\s)?\d{{5}}(?:-\d{{4}})?))?")
_STRONG_ADDRESS_BEFORE = re.compile(r"(?:wohnhaft(?: in)?|wohnt(?: in)?|anschrift(?: für den \w+)?|adresse|versand|living at|lives? at|address)\W*$", re.I)
_AMOUNT_BEHIND = re.compile(r"^\s*(?:g|mg|µg|kg|ml|l|kcal|kJ|%|°|EL|TL|Prozent|Uhr|Euro|€|Minuten|Stunden|Tagen?|Wochen?|Jahren?|Haushalte|Fällen|Personen|Teilnehmer\w*|[A-ZÄÖÜ][a-zäöü]+(?:bäume|proben|kinder|menschen))\b|^%")
# ---------------------------------------------------------------- name
_CAP = r"(?:[A-ZÄÖÜ][a-zäöüßéèáíóñç]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?|[A-ZÄÖÜ]{3,}(?:-[A-ZÄÖÜ]{2,})?)"
_INITIAL = r"[A-ZÄÖÜ]\."
_TITLES = r"(?:(?:Dr|Prof|Dipl|Ing|med|oec|troph|rer|nat|phil|vet|dent|h\.c|B\.?Sc|M\.?Sc|MBA|PD)\b\.?(?:-?(?:Ing|Oec|Biol|Psych)\b\.?)?\s*)*"
_SINGLE = r"(?:\b(?:Frau|Herrn?|Mrs?|Ms|Miss|Fräulein)\b\.?|\bDr\.|\bProf\.|(?:Grüße|Gruß|Grüßen|wishes|regards|Regards|Sincerely|sincerely|Cheers|LG),|\bich heiße|[Mm]ein Name ist|[Mm]y name is|I'm called)"
_STRONG = r"(?:Patient(?:in)?:|Klient(?:in)?:|Kontakt:|Ansprechpartner(?:in)?:|\bcontact\b|\bgez\.|Nachbar(?:in)?\b|neighbou?r\b|[Ee]ingesandt von|[Ss]ent in by|in der Nähe von|\blive near|ging an:|went to:|sent to:|Vertretung(?:\s\w+){0,2}:|[Cc]over (?:on )?\w+:|Die Probe von|[Tt]he sample (?:of|from)|Kollegin|Kollege)"
_WEAK = r"(?:(?:Grüßen|Hochachtungsvoll|faithfully|Sincerely|Cheers|LG),?(?=\s*\n))"
_NAME = rf"(?:{_INITIAL}{_S}{{1,3}}){{0,2}}{_CAP}(?:,?(?P<gap>\s{{1,3}})(?:{_INITIAL}\s{{1,2}}){{0,2}}{_CAP})?"
_ON_LINE = _NAME.replace(r"(?P<gap>\s{1,3})", rf"(?P<gap>{_S}{{1,3}})")
_CUED = re.compile(rf"(?P<cue>{_STRONG})\s*{_TITLES}(?P<name>{_NAME})(?![\wäöüß])")
_SINGLY_CUED = re.compile(rf"(?P<cue>{_SINGLE})\s*{_TITLES}(?P<name>{_ON_LINE})(?![\wäöüß])")
_WEAKLY_CUED = re.compile(rf"(?P<cue>{_WEAK})\s*{_TITLES}(?!(?:Frau|Herrn?|Mrs?|Ms|Miss|Dr|Prof)\b)(?P<name>{_ON_LINE})(?![\wäöüß])")
#: Parts of the cues, by which the places to look at are found.
_CUE_PARTS = ("Frau", "Herr", "Mr", "Ms", "Miss", "Fräulein", "Dr.", "Prof.", "Patient", "Klient", "Kontakt:", "Ansprech", "contact", "gez.", "Grüße", "Gruß", "wishes", "egards", "incerely", "Cheers", "LG", "heiße", "ame is", "Name ist", "m called", "achbar", "eighbo", "ingesandt von", "ent in by", "Nähe von", "live near", "ging an:", "went to:", "sent to:", "Vertretung", "over ", "Probe von", "ample ", "Kolleg", "Hochachtungsvoll", "faithfully")
_BRACKETED = re.compile(rf"(?<=\d)\s*\((?P<name>{_NAME})\)")
_NAME_BEHIND = re.compile(r"^(?:\s*,?\s*(?:geb\.|born|DOB)|\s*\((?:Tel|phone|Fon)|\s+wurde\s+unter|\s+was\s+filed|\s*;\s*\S+\s*(?:@|\(|\[|at\b)|\s*,\s*(?:Durchwahl|ext\b|extension)|\s+(?:übernimmt|runs)|\s+(?:unter|on)\s+[+(\d]|\s*,\s*(?:SSN|NI\b|National|passport|Ausweis|Reisepass|Steuer|SV-|KV-|Versicherten)|\s+und wiege|\s+and I\b|\s*,\s*anbei|\)|\s*,?\s*\n?\s*(?:[A-ZÄÖÜ][\wäöüß.]*\s){1,3}\d|\s*,\s*\d{1,3}\s[A-Z])")
#: Capitalised words that a cue may precede without being names.
_NO_NAMES = set(
    "Die Der Das Den Dem Ein Eine Einen Mit Von Für Wer Was Wie Wir Ihr Ihre Sie Bitte Danke Plan Anamnese Verlauf Mann Frau Herr Herren Frauen Damen Kinder Praxis Klinik Küche Redaktion Team Beratung Kasse Ernährung "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März April Mai Juni Juli August September Oktober November Dezember Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "The This That Please Thanks Dear Hello Next Plan History Patient Kontakt Sehr Liebe Lieber Hallo Moin Kurze Update Und Oder Aber Zur Zum Nach Bei Aus Ich Meine Mein Salat Suppe Helene Mobil Tel Durchwahl Sent Best Kind Yours Any Call My".split()
)


def _vote(yes: bool, no: bool = False) -> int:
    return -1 if no else int(yes)


def _places(text: str, part: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def _within(pattern: re.Pattern, text: str, places: list[int], before: int, behind: int):
    """Matches of a pattern around some places of a text, which are in order."""
    spans: list[list[int]] = []
    for place in places:
        start, stop = max(0, place - before), min(len(text), place + behind)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(stop, spans[-1][1])
        else:
            spans.append([start, stop])
    for start, stop in spans:
        yield from pattern.finditer(text, start, stop)


def _emails(text: str):
    for m in _within(_EMAIL, text, [h.start() for h in _MAY_EMAIL.finditer(text)], 70, 90):
        plain = "@" in m["at"]
        spoken = not plain and not re.search(r"[(\[{<]", m["at"])
        dots = bool(re.search(r"[.\[(]", m["domain"]))
        shaped = bool(re.search(r"[._+\d-]", m["local"]))
        before, behind = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 20]
        yield m.start(), m.end(), (
            _vote(plain or not spoken, spoken and not (shaped and dots)),
            _vote(bool(re.search(r"(?:mail|unter|schreib|an|to|;|at|kontakt|contact|:)\W*$", before, re.I)), before.endswith("g ")),
            _vote(bool(re.match(r"\s*(?:schicken|,|;|\.|😊|\n|$|please)", behind, re.I))),
            _vote(shaped or len(m["local"]) > 2),
            _vote(bool(re.search(r"[a-z]{2,}$", m["domain"], re.I)), not dots),
        ), ()


def _phones(text: str):
    regions = [(r.start(), r.end()) for r in _MAY_PHONE.finditer(text)]
    for m in (m for start, end in regions for m in _PHONE.finditer(text, start, min(len(text), end + 3)) if m.end() <= end):
        value = m.group()
        start = m.start()
        if value.startswith("(") and ")" not in value:
            value, start = value[1:], start + 1
        digits = sum(c.isdigit() for c in value)
        if not 7 <= digits <= 15:
            continue
        before, behind = text[max(0, start - 40) : start], text[start + len(value) : start + len(value) + 30]
        shaped = bool(_PHONE_SHAPES.match(value)) and not re.search(r"(?<![A-Za-z])[A-Z]\s?$", before)
        yield start, start + len(value), (
            _vote(shaped, bool(_DATE.match(value)) or not shaped),
            _vote(bool(_PHONE_BEFORE.search(before)), bool(_NO_DETAIL.search(before) or _ID_BEFORE.search(before))),
            _vote(bool(_PHONE_BEHIND.search(behind)), bool(_ID_BEHIND.search(behind) or _AMOUNT_BEHIND.search(behind))),
            _vote(value[0] in "+(" or value.startswith(("00", "01"))),
            _vote(8 <= digits <= 14, bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", value))),
        ), ()


#: What every well-formed number holds from its first digit on, and every labelled one from its own; each alternative of the
#: label holds one of the parts, in any case.
_MAY_ID = re.compile(r"\d[\dA-Z\s-]{7}")
_MAY_LABELLED = re.compile(r"\d(?:[A-Z/-]*\d){4}", re.I)
_LABEL_PARTS = ("steuer", "idnr", "sv-nr", "rv-nr", "kv-nr", "versicher", "ausweis", "pass", "ssn", "social security", "ni n", "national insurance", "nhs", "tax", "id card")


def _labelled_places(text: str) -> list[int]:
    places = [h.start() for h in _MAY_LABELLED.finditer(text)]
    folded = text.casefold() if places else ""
    return places if any(part in folded for part in _LABEL_PARTS) else []


def _ids(text: str):
    seen = set()
    for m in _within(_ID, text, [h.start() for h in _MAY_ID.finditer(text)], 3, 30):
        seen.add(m.start())
        before, behind = text[max(0, m.start() - 50) : m.start()], text[m.end() : m.end() + 45]
        labelled, named = bool(_ID_BEFORE.search(before)), bool(_ID_BEHIND.search(behind))
        yield m.start(), m.end(), (
            _vote(True),
            _vote(labelled, bool(_NO_DETAIL.search(before) or _PHONE_BEFORE.search(before) and not named)),
            _vote(named),
            _vote(bool(re.search(r"[A-Z]", m.group())) or "-" in m.group()),
            _vote(labelled or named, not (labelled or named)),
        ), ()
    for m in _within(_ID_LABELLED, text, _labelled_places(text), 200, 40):
        if m.start("n") not in seen and not any(m.start("n") <= s < m.end("n") for s in seen):
            behind = text[m.end("n") : m.end("n") + 45]
            yield m.start("n"), m.end("n"), (0, 1, _vote(bool(_ID_BEHIND.search(behind))), _vote(bool(re.search(r"[A-Z]", m["n"]))), 1), ()


_STREET_ENDS = tuple(re.findall(r"[a-zäöüß]+\.?", _STREET_END.replace("(?:", "").replace("\\", "")))
_STREET_STARTS = {"Am", "An", "Auf", "Im", "In", "Unter", "Zum", "Zur", "Zu", "Hinter", "Vor", "Bei", "Beim"}


def _may_follow_street(text: str, place: int) -> bool:
    """A quick look at the words before a number."""
    words = text[max(0, place - 60) : place].split()[-4:]
    return bool(words) and (words[-1].lower().endswith(_STREET_ENDS) or words[-1][0].isupper() and not _STREET_STARTS.isdisjoint(words))


def _german(text: str):
    """Addresses before house numbers, each sought behind the one found before it."""
    at = 0
    for h in _HOUSE_AT.finditer(text):
        place = h.start()
        if place < at or not _may_follow_street(text, place) or not _STREET_UP_TO.search(text, max(at, place - 60), place):
            continue
        m = _DE_ADDRESS.search(text, max(at, place - 60), min(len(text), h.end() + 80))
        while m is not None:
            yield m
            at = m.end()
            m = _DE_ADDRESS.search(text, max(at, place - 60), min(len(text), h.end() + 80)) if at <= place else None


def _addresses(text: str):
    english = _EN_ADDRESS.finditer(text) if any(x in text for x in _EN_STREETS) else ()
    for pattern, found in ((_DE_ADDRESS, _german(text)), (_EN_ADDRESS, english)):
        for m in found:
            before, behind = text[max(0, m.start() - 45) : m.start()], text[m.end() : m.end() + 25]
            suffixed = pattern is _EN_ADDRESS or bool(re.search(_STREET_END + "$", m["street"], re.I))
            placed = m["place"] is not None
            amount = not placed and bool(_AMOUNT_BEHIND.match(behind))
            introduced = bool(_STRONG_ADDRESS_BEFORE.search(before) or re.search(rf"{_CAP}(?:,{_S}?|{_S}*\n\s*)$", before))
            yield m.start(), m.end(), (
                _vote(suffixed, amount),
                _vote(introduced, bool(_NO_DETAIL.search(before))),
                _vote(placed or bool(re.match(r"\s*(?:[.,]|\n|$)", behind)), amount),
                _vote(placed, not (placed or suffixed or introduced)),
                _vote(suffixed and introduced or placed, not introduced and not placed),
            ), ()


def _names(text: str):
    done = set()
    places = sorted(p for part in _CUE_PARTS for p in _places(text, part))
    strong = _within(_CUED, text, places, 30, 170) if places else ()
    weak = _WEAKLY_CUED.finditer(text) if places else ()
    single = _within(_SINGLY_CUED, text, places, 30, 170) if places else ()
    for pattern, found in ((_CUED, strong), (_SINGLY_CUED, single), (_WEAKLY_CUED, weak), (_BRACKETED, _within(_BRACKETED, text, _places(text, "("), 4, 80))):
        for m in found:
            start, end = m.span("name")
            if start in done:
                continue
            cue = "(" if pattern is _BRACKETED else m["cue"]
            single_cue = pattern is _SINGLY_CUED
            value = text[start:end]
            words = re.findall(_CAP, value)
            if len(words) > 1 and words[1] in _NO_NAMES:
                end = start + len(re.match(rf"(?:{_INITIAL}\s+)*{_CAP}", value).group())
                value, words = text[start:end], words[:1]
            value = text[start:end].rstrip(", \n")
            end = start + len(value)
            done.add(start)
            behind = text[end : end + 45]
            odd = any(w in _NO_NAMES for w in words)
            yield start, end, (
                _vote(len(words) == 2 or bool(re.match(_INITIAL, value)) or single_cue, odd),
                _vote(pattern is not _WEAKLY_CUED, odd),
                _vote(bool(_NAME_BEHIND.match(behind))),
                0,
                _vote(len(value) >= 3 and not any(c.isdigit() for c in value), bool(re.match(r"-\w|\s*-(?:Salat|Suppe)", behind))),
            ), tuple(words)


_FINDERS = {"email": _emails, "phone": _phones, "id_number": _ids, "address": _addresses, "name": _names}


def proposed(text: str) -> list[tuple[str, int, int, str, tuple]]:
    """``(kind, start, end, votes, words)`` of every proposed span of a text."""
    out = []
    for kind, find in _FINDERS.items():
        for start, end, votes, words in find(text):
            out.append((kind, start, end, "".join("-0+"[v + 1] for v in votes), words))
    return out


class SpanClassifier:
    """Which vote patterns of each kind make a detail."""

    def __init__(self) -> None:
        self.accepted: dict[tuple[str, str], float] = {}

    def fit(self, counts: list[tuple[str, str, int]]) -> SpanClassifier:
        """From ``kind, votes, number of spans`` of the whole corpus."""
        for kind in KINDS:
            rows = [(v, n) for k, v, n in counts if k == kind]
            if not rows:
                continue
            votes = np.array([["-0+".index(c) for c in v] for v, _ in rows])
            n = np.array([c for _, c in rows], float)
            p = self._aggregate(votes, n)
            self.accepted |= {(kind, v): float(x) for (v, _), x in zip(rows, self._classify(votes, n, p))}
        return self

    def _aggregate(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of each pattern by expectation-maximisation over labeler reliabilities; abstentions are informative
        too. The start is the balance of the votes, and every labeler is taken to be right more often than wrong."""
        balance = (votes - 1).sum(1)
        p = 1 / (1 + np.exp(-1.5 * (balance - 0.5)))
        for _ in range(ROUNDS):
            log = np.zeros((len(n), 2))
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                log[:, c] = np.log(w.sum() + 5)
                for j in range(votes.shape[1]):
                    seen = np.bincount(votes[:, j], weights=w, minlength=3) + (np.array([0.5, 2.0, 6.0]) if c else np.array([6.0, 3.0, 1.0]))
                    log[:, c] += np.log(seen / seen.sum())[votes[:, j]]
            p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        return p

    def _classify(self, votes: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """A logistic classifier on the votes, trained on the aggregated probabilities."""
        x = np.concatenate([np.ones((len(n), 1)), (votes == 2), (votes == 0)], axis=1).astype(float)
        w = np.zeros(x.shape[1])
        weight = np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(STEPS):
            q = 1 / (1 + np.exp(-x @ w))
            w += 2.0 * (x.T @ (weight * (p - q)) - 1e-4 * w)
        return 1 / (1 + np.exp(-x @ w))

    def accepts(self, kind: str, votes: str) -> bool:
        return self.accepted.get((kind, votes), 0.0) >= ACCEPT


_PROPOSED = "doc_id bigint, copy bigint, kind string, start int, end int, value string, votes string, words array<string>"


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
    names = ["doc_id", "copy", "kind", "start", "end", "value", "votes", "words"]
    for batch in batches:
        columns: list[list] = [[] for _ in types]
        for doc_id, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "text"))):
            for kind, start, end, votes, words in proposed(text):
                for column, x in zip(columns, (doc_id, copy, kind, start, end, " ".join(text[start:end].split()), votes, list(words))):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _judged(documents: DataFrame) -> DataFrame:
    """Accepted spans: ``doc_id, copy, kind, start, end, value``; ``copy`` is a hash of the text they stand in.

    The texts are read once, in a narrow map; the proposed spans are written to the shared folder, and gazetteer, vote
    counts and the decision work on them. The gazetteer is a join, so it may be of any size; vote patterns are at most
    3**5 for each kind.
    """
    texts = spread(documents.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("copy"), "text"))
    spans = staged(texts.mapInArrow(_proposals, _PROPOSED))
    key = ["doc_id", "copy", "start", "end"]
    names = spans.where("kind = 'name'").select(*key, "votes", F.explode("words").alias("word")).withColumn("word", F.initcap("word"))
    strong = names.where("substr(votes, 1, 2) = '++'").select("doc_id", "word").distinct()
    known = strong.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_IN).select("word")
    seen = names.join(known, "word").select(*key).distinct().withColumn("kind", F.lit("name")).withColumn("known", F.lit(True))
    vote = F.when(F.col("known"), F.concat(F.substring("votes", 1, 3), F.lit("+"), F.substring("votes", 5, LABELERS))).otherwise(F.col("votes"))
    judged = staged(spans.drop("words").join(seen, [*key, "kind"], "left").withColumn("votes", vote).drop("known"))
    counts = judged.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    classifier = SpanClassifier().fit([tuple(r) for r in counts])
    accepted = [[k, v] for (k, v), p in classifier.accepted.items() if p >= ACCEPT]
    keep = documents.sparkSession.createDataFrame(accepted or [["", ""]], "kind string, votes string")
    return judged.join(F.broadcast(keep), ["kind", "votes"]).drop("votes")


def details(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, value`` of every distinct detail of a private person. Null and empty texts give no rows."""
    return _judged(documents).select("doc_id", "kind", "value").distinct()


def masked_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` with every detail replaced by a placeholder of its type; the rest of the text is unchanged.

    Where spans overlap, the longer one gives the placeholder. Null texts stay null, rows are neither lost nor doubled.
    """
    spans = _judged(documents).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "end", "kind")).alias("spans"))
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("copy")).join(spans, ["doc_id", "copy"], "left")

    @F.pandas_udf(T.StringType())
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([masked(t, [(x["start"], x["end"], x["kind"]) for x in s]) if s is not None else t for t, s in zip(texts, spans)], dtype=object)

    return keyed.select("doc_id", mask("text", "spans").alias("text"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with placeholders for ``(start, end, kind)``."""
    chosen: list[tuple[int, int, str]] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(span[1] <= c[0] or span[0] >= c[1] for c in chosen):
            chosen.append(span)
    out, at = [], 0
    for start, end, kind in sorted(chosen):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]
