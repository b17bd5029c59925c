"""Column functions on text. White space is Unicode white space as ``str.isspace`` has it, spelled out for the JVM's regexes."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The code points of white space and of line ends, for the JVM's regular expressions.
SPACE = r"\t-\r \x1c-\x1f\x85   -     　"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85  ]"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: The patterns of the cleaning steps.
URL = rf"http[^{SPACE}]+"
TAG = r"<[^>]+>"
BROKEN_WORD = rf"({WORD_CHAR})-[{SPACE}]+({WORD_CHAR})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space off both ends, Unicode white space included."""
    return F.regexp_replace(_col(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), rf"[{SPACE}]+", " "))


def lines(c: Column | str) -> Column:
    """The lines of a text without their ends."""
    return F.split(_col(c), LINE_END)


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), URL, "")


def strip_tags(c: Column | str) -> Column:
    """Each ``<...>`` as one blank, also across lines."""
    return F.regexp_replace(_col(c), TAG, " ")


def dehyphenate(c: Column | str) -> Column:
    """Words that a hyphen and white space break, joined."""
    return F.regexp_replace(_col(c), BROKEN_WORD, "$1$2")


@F.pandas_udf(T.StringType())
def unescape_and_compose(texts: pd.Series) -> pd.Series:
    """HTML entities resolved once, then Unicode compatibility composition: what the JVM has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def clean(c: Column | str) -> Column:
    """URLs, tags, entities, compatibility forms, broken words and white space, in this order. Null stays null.

    Only the third and fourth step leave the JVM, in Arrow batches.
    """
    return collapse_space(dehyphenate(unescape_and_compose(strip_tags(strip_urls(c)))))


def clean_text(text: str | None) -> str | None:
    """The same for one text, by Python's own Unicode tables."""
    if text is None:
        return None
    for pattern, replacement in ((r"http\S+", ""), (TAG, " ")):
        text = re.sub(pattern, replacement, text)
    text = unicodedata.normalize("NFKC", html.unescape(text))
    return " ".join(re.sub(r"(\w)-\s+(\w)", r"\1\2", text).split())


clean_exactly = F.pandas_udf(lambda texts: texts.map(clean_text), T.StringType())


def letters(c: Column | str) -> Column:
    """Number of letters."""
    return F.length(F.regexp_replace(_col(c), r"[^\p{L}]", ""))


def has_content(c: Column | str, least: float = 0.5) -> Column:
    """Whether at least a share of a page's characters, white space at its ends left off, are letters. Null has none."""
    bare = strip(c)
    return F.coalesce((F.length(bare) > 0) & (letters(bare) >= least * F.length(bare)), F.lit(False))


def markdown_table(cells: Column | str) -> Column:
    """A table of cells, row 0 its header, as Markdown; null and empty tables give null. Cells are stripped, null is empty."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), " | "), F.lit(" |"))
    cells = _col(cells)
    header = F.element_at(cells, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda x: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(row(header), rule), body), "\n"))


def numbers(c: Column | str) -> Column:
    """All runs of digits as 38-digit decimals, in order; longer ones are null, signs and points are ignored."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)"))
