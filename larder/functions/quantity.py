"""A grammar for quantities: numbers, unit expressions and time spans.

A unit is an exponent vector over base dimensions together with an affine map to canonical units
(``canonical = value * scale + offset``). Multiplying units adds vectors, dividing subtracts them, so ``mg/kg`` has
no mass and ``mg/d`` has mass 1 and time -1. Time is counted in days.

    text      := item*
    item      := number [power] | multiplier | ("/" | per-word) [number] unit | unit [power] | frequency | every-phrase
    power     := "^" ["-"] digits
    frequency := number ("x" | "mal" | "times") | "zweimal" | "twice"
    every     := ("alle" | "every" | "jeden") [number | ordinal | "other"] span
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from fractions import Fraction

#: The base dimensions; the last three never lead to an amount per day.
DIMENSIONS = ("mass", "energy", "volume", "activity", "time", "temperature", "share", "count", "occasion")

#: Metric prefixes as written before a base unit.
PREFIXES = {
    "n": Fraction(1, 10**9), "nano": Fraction(1, 10**9),
    "μ": Fraction(1, 10**6), "u": Fraction(1, 10**6), "mc": Fraction(1, 10**6), "mikro": Fraction(1, 10**6), "micro": Fraction(1, 10**6),
    "m": Fraction(1, 1000), "milli": Fraction(1, 1000),
    "c": Fraction(1, 100), "zenti": Fraction(1, 100), "centi": Fraction(1, 100),
    "d": Fraction(1, 10), "dezi": Fraction(1, 10), "deci": Fraction(1, 10),
    "h": Fraction(100), "hekto": Fraction(100), "hecto": Fraction(100),
    "k": Fraction(1000), "kilo": Fraction(1000),
    "mega": Fraction(10**6),
}

#: Spellings of the base units that take prefixes.
BASES = {
    "g": ("g", "gr", "gramm", "gramme", "gram", "grams", "grammes"),
    "cal": ("cal", "kalorie", "kalorien", "calorie", "calories"),
    "j": ("j", "joule", "joules"),
    "l": ("l", "lt", "ltr", "liter", "litre", "litres", "liters"),
}

#: Words with a meaning of their own. Food labels call the kilocalorie a calorie.
WHOLE_WORDS = {
    "kilo": ("g", 1000), "kilos": ("g", 1000), "pfund": ("g", 500),
    "cal": ("cal", 1000), "kalorie": ("cal", 1000), "kalorien": ("cal", 1000), "calorie": ("cal", 1000), "calories": ("cal", 1000),
    "mj": ("j", 10**6),
}
ACTIVITY = {"iu", "ie", "ui", "internationale einheiten", "internationale einheit", "international units", "international unit"}
SPANS = {
    1: "d day days daily tag tage tagen tages tgl tägl täglich täglicher pro-tag",
    7: "w wk week weeks weekly woche wochen wöchentl wöchentlich",
    30: "mo month months monthly monat monate monaten monatl monatlich",
    365: "yr year years yearly annually jahr jahre jahren jährlich",
}
HOURS = {"h": 1, "std": 1, "stunde": 1, "stunden": 1, "hour": 1, "hours": 1, "hourly": 1, "stündlich": 1}
ADVERBS = set("daily täglich tgl tägl weekly wöchentlich wöchentl monthly monatlich monatl yearly annually jährlich hourly stündlich".split())
OCCASIONS = set("meal meals mahlzeit mahlzeiten serving servings portion portionen portions dose dosen dosis tablette kapsel".split())
SHARES = set("% prozent percent e dv nrv rda der energie energy kcal% en% en nährwert tagesbedarfs referenzwert of".split())
HOUSEHOLD = set("stück stücke stk tasse tassen handvoll esslöffel teelöffel el tl glas gläser scheibe scheiben cup cups slice slices piece pieces tablespoon teaspoon tbsp tsp".split())
PER = set("per pro je a an am im in jede jeden jeder each every alle in-the the".split())
EVERY = set("alle every jeden jede jedes jeder".split())
TIMES = {"x", "×", "mal", "times", "time"}
FREQUENCY = {"einmal": 1, "zweimal": 2, "dreimal": 3, "viermal": 4, "fünfmal": 5, "sechsmal": 6, "once": 1, "twice": 2, "thrice": 3}
NUMBER_WORDS = {
    "ein": 1, "eine": 1, "einen": 1, "eins": 1, "one": 1, "zwei": 2, "two": 2, "drei": 3, "three": 3, "vier": 4, "four": 4,
    "fünf": 5, "five": 5, "sechs": 6, "six": 6, "sieben": 7, "seven": 7, "acht": 8, "eight": 8, "neun": 9, "nine": 9, "zehn": 10, "ten": 10,
    "zwölf": 12, "twelve": 12, "vierzehn": 14, "fourteen": 14,
}
ORDINALS = {"other": 2, "second": 2, "zweiten": 2, "zweite": 2, "zweiter": 2, "anderen": 2, "third": 3, "dritten": 3, "dritte": 3, "fourth": 4, "vierten": 4}
MULTIPLIERS = {"tsd": 1000, "tausend": 1000, "thousand": 1000, "hundert": 100, "hundred": 100, "dutzend": 12, "dozen": 12, "mio": 10**6, "million": 10**6, "millionen": 10**6}
SUPERSCRIPTS = {"⁰": "^0", "¹": "^1", "²": "^2", "³": "^3", "⁴": "^4", "⁵": "^5", "⁶": "^6", "⁷": "^7", "⁸": "^8", "⁹": "^9", "⁻": "^-"}
TEMPERATURES = {"°c": (Fraction(1), Fraction(27315, 100)), "°f": (Fraction(5, 9), Fraction(45967, 180)), "kelvin": (Fraction(1), Fraction(0))}

#: Longest number that is read, in characters, and largest exponent; beyond them a text is not understood.
LONGEST_NUMBER, MOST_POWER = 40, 99

_SPAN_DAYS = {word: Fraction(days) for days, words in SPANS.items() for word in words.split()} | {w: Fraction(n, 24) for w, n in HOURS.items()}
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|°[cf]\b|[^\W\d_]+(?:\.[^\W\d_]+)*\.?|[/*×·%^()-]")


@dataclass(frozen=True)
class Unit:
    """An exponent vector with the affine map to canonical units."""

    vector: tuple = (0,) * len(DIMENSIONS)
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def times(self, other: Unit, power: int = 1) -> Unit:
        vector = tuple(a + power * b for a, b in zip(self.vector, other.vector))
        return Unit(vector, self.scale * other.scale**power, other.offset if not any(self.vector) and power == 1 else Fraction(0))

    def exponent(self, dimension: str) -> int:
        return self.vector[DIMENSIONS.index(dimension)]


def base_unit(dimension: str, scale=1, offset=0) -> Unit:
    return Unit(tuple(int(d == dimension) for d in DIMENSIONS), Fraction(scale), Fraction(offset))


@dataclass
class Reading:
    """What one text states: a unit (without its time span), a span in days per occurrence, or nothing readable."""

    unit: Unit = field(default_factory=Unit)
    has_unit: bool = False
    days: Fraction | None = None
    understood: bool = True


class Lexicon:
    """Resolves unit words against a table of ``unit, dimension, factor_to_base``."""

    def __init__(self, rows: list[tuple[str, str, float | None]]):
        self.factors = {unit: (dimension, Fraction(str(factor))) for unit, dimension, factor in rows if factor is not None and factor == factor}
        anchor = {"g": ("g", 1), "cal": ("kcal", 1000), "j": ("kJ", 1000), "l": ("l", 1)}
        self.words: dict[str, Unit] = {}
        for base, spellings in BASES.items():
            code, per = anchor[base]
            if code not in self.factors:
                continue
            dimension, factor = self.factors[code]
            for spelling in spellings:
                self.words[spelling] = base_unit(dimension, factor / per)
                for prefix, power in PREFIXES.items():
                    if len(prefix) > 2 or len(spelling) < 4 or spelling == "gr":
                        self.words[prefix + spelling] = base_unit(dimension, factor / per * power)
        for word, (base, power) in WHOLE_WORDS.items():
            code, per = anchor[base]
            if code in self.factors:
                self.words[word] = base_unit(self.factors[code][0], self.factors[code][1] / per * power)
        for word in ACTIVITY:
            if "IU" in self.factors:
                self.words[word] = base_unit(*self.factors["IU"])
        for unit, (dimension, factor) in self.factors.items():
            key = unicodedata.normalize("NFKC", unit).lower()
            self.words.setdefault(key, base_unit(dimension, factor))
        for word, (scale, offset) in TEMPERATURES.items():
            self.words[word] = base_unit("temperature", scale, offset)

    def unit(self, word: str) -> Unit | None:
        return self.words.get(word)


def number(text: str) -> Fraction:
    """``1.000`` and ``1,000`` are a thousand, ``0,5`` and ``0.5`` a half; with both signs the last is the decimal one."""
    if re.fullmatch(r"[1-9]\d{0,2}(\.\d{3})+|[1-9]\d{0,2}(,\d{3})+", text):
        return Fraction(re.sub(r"[.,]", "", text))
    last = max(text.rfind("."), text.rfind(","))
    if last < 0:
        return Fraction(text)
    return Fraction(re.sub(r"[.,]", "", text[:last]) + "." + text[last + 1 :])


def _tokens(text: str) -> list[str]:
    for sign, plain in SUPERSCRIPTS.items():
        text = text.replace(sign, plain)
    text = unicodedata.normalize("NFKC", text).lower().replace("_", " ").replace("µ", "μ")
    found = []
    for token in _TOKEN.findall(text):
        word = token.strip(".") if token[0].isalpha() else token
        if "." in word and word[0].isalpha():
            parts = word.split(".")
            if all(len(p) == 1 for p in parts):
                word = "".join(parts)
                found.append(word)
            else:
                found.extend(p for p in parts if p)
            continue
        found.append(word)
    return found


def _exponent(tokens: list[str], i: int) -> tuple[int | None, int]:
    """The exponent that starts at token ``i``, which is ``^``, None if it is no small whole number, and the next token."""
    sign, i = 1, i + 1
    while i < len(tokens) and tokens[i] in ("-", "^"):
        sign, i = -sign if tokens[i] == "-" else sign, i + 1
    if i == len(tokens) or not tokens[i].isdecimal():
        return None, i
    digits = tokens[i].lstrip("0") or "0"
    return (sign * int(digits) if len(digits) <= len(str(MOST_POWER)) else None), i + 1


def read(text: str | None, lexicon: Lexicon) -> Reading:
    """Parse one field. Null and blank text state nothing, and that is understood. An exponent binds to the unit or number
    just before it; one that binds to nothing, zero to no positive power, and numbers or powers beyond the bounds above are
    not understood."""
    out = Reading()
    if text is None or not text.strip():
        return out
    tokens = _tokens(text)
    unit, count, days, i, power = Unit(), Fraction(1), None, 0, 1
    # what an exponent would bind to: a number, or a unit with what stood before it and its sign
    bound: tuple[Unit, Unit, int] | Fraction | None = None

    def give_span(value: Fraction) -> None:
        nonlocal days
        days = value if days is None else days
        if days != value:
            out.understood = False

    while i < len(tokens):
        token, binds = tokens[i], bound
        bound = None
        if token == "^":
            exponent, i = _exponent(tokens, i)
            if exponent is None or binds is None:
                out.understood = False
            elif isinstance(binds, Fraction):
                out.understood = out.understood and (binds != 0 or exponent > 0)
                count = count * binds ** (exponent - 1) if binds else count
            else:
                unit = binds[0].times(binds[1], binds[2] * exponent)
            continue
        pair = f"{token} {tokens[i + 1]}" if i + 1 < len(tokens) else ""
        if pair and lexicon.unit(pair):
            token, i = pair, i + 1
        elif pair and token in PREFIXES and token not in lexicon.words and lexicon.unit(token + tokens[i + 1]):
            token, i = token + tokens[i + 1], i + 1
        elif token in EVERY and power == 1:
            step, j = Fraction(1), i + 1
            if j < len(tokens) and (tokens[j][0].isdigit() or tokens[j] in NUMBER_WORDS or tokens[j] in ORDINALS):
                word = tokens[j]
                step = number(word) if word[0].isdigit() else Fraction(NUMBER_WORDS.get(word) or ORDINALS[word])
                j += 1
            if j < len(tokens) and tokens[j] in _SPAN_DAYS and step > 0:
                give_span(step * _SPAN_DAYS[tokens[j]])
                i = j + 1
                continue
        if token[0].isdigit() or token in NUMBER_WORDS and token not in PER:
            if len(token) > LONGEST_NUMBER:
                out.understood = False
                break
            value = number(token) if token[0].isdigit() else Fraction(NUMBER_WORDS[token])
            if power == -1:
                unit = Unit(unit.vector, unit.scale / value, unit.offset) if value else unit
                if i + 1 < len(tokens) and tokens[i + 1] in _SPAN_DAYS and value:
                    unit = Unit(unit.vector, unit.scale * value, unit.offset)
                    give_span(value * _SPAN_DAYS[tokens[i + 1]])
                    i, power = i + 1, 1
            else:
                count, bound = count * value, value
        elif token in FREQUENCY:
            count *= FREQUENCY[token]
        elif token in MULTIPLIERS:
            count *= MULTIPLIERS[token]
        elif token in TIMES or token in "*·()-":
            pass
        elif token == "/" or (token in PER and token not in _SPAN_DAYS):
            power = -1 if token not in ("of", "the") else power
        elif token in _SPAN_DAYS and (power == -1 or token in ADVERBS or not out.has_unit and token != "d" and token != "w" and token != "h"):
            give_span(_SPAN_DAYS[token])
            power = 1
        elif token in OCCASIONS:
            unit, power, out.has_unit = unit.times(base_unit("occasion"), power), 1, True
        elif lexicon.unit(token) is not None:
            bound = unit, lexicon.unit(token), power
            unit, power, out.has_unit = unit.times(lexicon.unit(token), power), 1, True
        elif token in SHARES:
            unit, out.has_unit, power = unit.times(base_unit("share")), True, 1
        elif token in HOUSEHOLD:
            unit, out.has_unit, power = unit.times(base_unit("count"), power), True, 1
        else:
            out.understood = False
        i += 1
    out.unit, out.days = Unit(unit.vector, unit.scale * count, unit.offset), days
    if not out.has_unit:
        out.unit = Unit(scale=count)
    return out


#: The dimensions whose amounts per day are stated.
STATED = ("mass", "energy", "volume", "activity")


def daily_factor(unit_text: str | None, time_text: str | None, lexicon: Lexicon) -> tuple[str | None, Fraction | None, str | None]:
    """Dimension and factor that turn an amount as written into an amount per day in base units, or the reason why not."""
    unit, span = read(unit_text, lexicon), read(time_text, lexicon)
    if not unit.understood and not unit.has_unit:
        return None, None, "unit not readable"
    if not unit.understood or not span.understood:
        return None, None, "text not readable"
    if unit.has_unit and span.has_unit:
        if span.unit.exponent("occasion"):
            return None, None, "span does not lead to days"
        if span.unit.vector != unit.unit.vector:
            return None, None, "two different units"
        stated = unit.unit
    else:
        stated = Unit().times(unit.unit).times(span.unit)
    if stated.exponent("occasion"):
        return None, None, "span does not lead to days"
    if not (unit.has_unit or span.has_unit):
        return None, None, "no unit"
    if unit.days and span.days and unit.days != span.days:
        return None, None, "two different spans"
    days = unit.days or span.days or Fraction(1)
    for dimension in STATED:
        if stated.vector == base_unit(dimension).vector:
            return dimension, stated.scale / days, None
    return None, None, "no amount of a measured dimension"


def convert(value: float, unit: str, target: str, lexicon: Lexicon) -> float | None:
    """``value`` of one unit expression in another, by scale and offset; None if the vectors differ."""
    a, b = read(unit, lexicon), read(target, lexicon)
    if not (a.understood and b.understood and a.has_unit and b.has_unit) or a.unit.vector != b.unit.vector or a.days != b.days:
        return None
    return float((Fraction(str(value)) * a.unit.scale + a.unit.offset - b.unit.offset) / b.unit.scale)
