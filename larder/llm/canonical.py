"""Mapping free-entered values to a canonical list.

Values are deduplicated, normalised and turned into weighted character n-grams. An inverted index of n-grams (a join on the
gram) gives the candidates: grams are ordered from rare to frequent, and only those of a form enter the join whose rest of
the form still weighs as much as the threshold, on both sides, which loses no pair above it. The weighted cosine of each
candidate is then computed whole. An entry is accepted with a cosine above the threshold if an edit-distance check holds, and
by a margin over the best entry of any other id that passes the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.staging import staged

#: Words that qualify a quantity without changing what is measured.
QUALIFIERS = set("gesamt total davon of which dietary zufuhr intake the der die das von insgesamt summe".split())
#: Weights of grams by length. Single letters would be in every posting list and are left to the edit check.
GRAM_WEIGHTS = {2: 1.0, 3: 1.0}
#: A gram in n entries weighs log(1 + RARITY / n).
RARITY = 1000.0
#: Smallest cosine, smallest lead over another id, smallest share of letters that an edit must keep.
THRESHOLD, MARGIN, LEAST_KEPT = 0.25, 0.01, 0.65

_DIGRAPH = re.compile(r"([aou])e")
_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"([a-z])\1+")
_CODE = re.compile(r"[abcdek]\d{0,2}")


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours (optimal string alignment)."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def _vitamin(word: str) -> bool:
    return word in ("vit", "vitamin") or len(word) == 7 and edits(word, "vitamin") <= 1


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def forms(value: str) -> list[str]:
    """The normal forms of one value: with and without qualifying words, a misread digit as either letter, an umlaut as one letter or two.

    A form is a space-separated list of words; a vitamin code or a number stands as a word of its own after ``#``.
    """
    out: list[str] = []
    folded = _fold(value)
    spelled = dict.fromkeys((_DIGRAPH.sub(r"\1", folded), folded))
    for text, one in ((t, o) for t in spelled for o in ("li" if "1" in value else "l")):
        words, codes = [], []
        for word in _WORD.findall(text):
            tail = re.fullmatch(r"(vit|[a-z]{6,8})([abcdek]\d{0,2})", word)
            if tail and (tail[1] == "vit" or edits(tail[1], "vitamin") <= 1) and word != "vitamine":
                words.append("vitamin")
                codes.append(tail[2])
            elif _CODE.fullmatch(word) or word.isdigit():
                codes.append(word)
            elif word.startswith("omega") and word[5:].isdigit():
                words.append("omega")
                codes.append(word[5:])
            else:
                if any(c.isdigit() for c in word) and sum(c.isalpha() for c in word) >= 2:
                    word = word.replace("0", "o").replace("1", one).replace("3", "e").replace("5", "s").replace("4", "a")
                words.append("vitamin" if _vitamin(word) and word != "vitamine" else word)
        if "vitamine" in words:
            words = ["vitamin" if w == "vitamine" else w for w in words]
            codes = codes or ["e"]
        code = "".join(codes) if "vitamin" in words else " ".join(codes)
        for kept in (words, [w for w in words if w not in QUALIFIERS]):
            text = " ".join(_RUN.sub(r"\1", w) for w in kept) + (f" #{code}" if code else "")
            if kept and text not in out:
                out.append(text)
    return out


def grams(form: str) -> dict[str, float]:
    """Counts of the padded n-grams of each word, so that the order of words makes no difference."""
    out: dict[str, float] = {}
    for word in form.partition(" #")[0].split():
        padded = f"^{word}$"
        for n, weight in GRAM_WEIGHTS.items():
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram not in "^$":
                    out[gram] = out.get(gram, 0.0) + weight
    return out


def kept(form: str, entry: str) -> float:
    """Share of letters that stay when one form is edited into the other, in any order of words; 0 if the codes differ."""
    a, _, code_a = form.partition(" #")
    b, _, code_b = entry.partition(" #")
    if code_a != code_b:
        return 0.0
    pairs = ((a, b), (a.replace(" ", ""), b.replace(" ", "")), (" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    return 1 - min(edits(x, y) / max(len(x), len(y), 1) for x, y in pairs)


_GRAM = T.StructType([T.StructField("gram", T.StringType()), T.StructField("weight", T.DoubleType())])
_FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("grams", T.ArrayType(_GRAM))])


@F.pandas_udf(T.ArrayType(_FORM))
def _forms(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"form": f, "grams": [{"gram": g, "weight": w} for g, w in grams(f).items()]} for f in forms(v)])


@F.pandas_udf(T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("kept", T.DoubleType())]))
def _compared(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Cosine of a form and an entry, each with its grams and weights of length 1, and the kept share above the threshold."""
    for forms_, entries, asked, known in batches:
        out = []
        for form, entry, a, b in zip(forms_, entries, asked, known):
            weights = {x["gram"]: x["u"] for x in b}
            cosine = sum(x["u"] * weights.get(x["gram"], 0.0) for x in a)
            out.append((cosine, kept(form, entry) if cosine >= THRESHOLD else None))
        yield pd.DataFrame(out, columns=["cosine", "kept"], dtype="float64")


def _postings(df: DataFrame, column: str) -> DataFrame:
    """``column, form, grams`` of every form of every value."""
    return df.select(column, F.explode(_forms(column)).alias("f")).select(column, "f.form", "f.grams")


def _weighted(forms_: DataFrame, counts: DataFrame, unknown: Column) -> DataFrame:
    """``form, gram, u, leads`` of distinct forms: weights scaled to length 1, and whether the gram is one of those that a
    pair above the threshold must share, which is where the grams from it to the most frequent one still weigh as much."""
    one = forms_.select("form", F.explode("grams").alias("g")).select("form", "g.gram", "g.weight")
    heavy = one.join(counts, "gram", "left").select("form", "gram", F.coalesce("df", F.lit(0)).alias("df"), (F.col("weight") * F.coalesce("idf", unknown)).alias("w"))
    whole = Window.partitionBy("form")
    rest = whole.orderBy(F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("w") * F.col("w")
    length = F.sqrt(F.sum(square).over(whole))
    behind = F.sqrt(F.sum(square).over(rest))
    return heavy.select("form", "gram", (F.col("w") / length).alias("u"), (behind >= (THRESHOLD - 1e-9) * length).alias("leads"))


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``value, entry_id, score, lead`` for each distinct non-null ``value``; ``entry_id`` is null if no entry is meant.

    ``reference`` has ``alias, entry_id``. Nothing is broadcast by hand and nothing collected: the inverted index is an
    equi-join on the gram, over distinct forms only, so the reference list and the values may both grow; Spark broadcasts
    the reference side where its own size estimate allows it. All entries above the threshold are compared, however many.
    Without a lead over the second id a value stays unmatched. Values without letters or digits are unmatched.
    """
    entries = staged(_postings(reference.where(F.col("alias").isNotNull()).select("alias").distinct(), "alias"))
    asked = staged(_postings(values.select("value").distinct(), "value"))
    ids = reference.select("alias", "entry_id").where(F.col("entry_id").isNotNull()).distinct()
    known, free = (x.select("form", "grams").distinct() for x in (entries, asked))
    counts = known.select(F.explode("grams.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log1p(F.lit(RARITY) / F.col("df")))
    index = _weighted(known, counts, F.lit(0.0))
    sought = _weighted(free, counts, F.log1p(F.lit(RARITY)))
    pairs = sought.where("leads").select("form", "gram").join(index.where("leads").select(F.col("form").alias("entry"), "gram"), "gram").select("form", "entry").distinct()
    same_code = F.substring_index("form", " #", -1) == F.substring_index("entry", " #", -1)
    coded = F.col("form").contains(" #") | F.col("entry").contains(" #")
    spans = lambda f: (F.length(f), F.length(F.replace(f, F.lit(" "), F.lit(""))))
    near = [F.least(x, y) >= LEAST_KEPT * F.greatest(x, y) - 1e-9 for x, y in zip(*(spans(F.substring_index(c, " #", 1)) for c in ("form", "entry")))]
    vectors = lambda df, name: df.groupBy(F.col("form").alias(name)).agg(F.collect_list(F.struct("gram", "u")).alias(f"{name}_grams"))
    met = pairs.where((~coded | same_code) & (near[0] | near[1])).join(vectors(sought, "form"), "form").join(vectors(index, "entry"), "entry")
    scored = met.select("form", "entry", _compared("form", "entry", "form_grams", "entry_grams").alias("c")).select("form", "entry", "c.*")
    passed = scored.where((F.col("cosine") >= THRESHOLD) & (F.col("kept") >= LEAST_KEPT))
    named = entries.select("alias", F.col("form").alias("entry")).distinct().join(ids, "alias").select("entry", "entry_id").distinct()
    by_id = asked.select("value", "form").join(passed.join(named, "entry"), "form").groupBy("value", "entry_id").agg(F.max("cosine").alias("score"))
    order = Window.partitionBy("value").orderBy(F.desc("score"), "entry_id")
    ranked = by_id.withColumn("lead", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("n", F.row_number().over(order))
    best = ranked.where("n = 1").select("value", F.when(F.col("lead") >= MARGIN, F.col("entry_id")).alias("entry_id"), "score", "lead")
    return values.select("value").distinct().join(best, "value", "left")
