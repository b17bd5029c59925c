"""Cleaning of paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import clean, collapse_space, has_content, lines

#: Occurrences in a document from which a line is a running line.
REPEATED = 3
#: Pages of a document that become one text; longer documents become several texts, so that no document is gathered whole.
PART = 1000


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no, line`` of every non-blank line, white space levelled."""
    split = pages.select("doc_id", "page_no", F.posexplode(lines("text")).alias("line_no", "line"))
    return split.withColumn("line", collapse_space("line")).where(F.col("line") != "")


def repeated_lines(pages: DataFrame, times: int = REPEATED) -> DataFrame:
    """``doc_id, line, n`` of the lines that occur ``times`` or more in a document, on whatever page."""
    return page_lines(pages).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def remove_repeated_lines(pages: DataFrame, times: int = REPEATED) -> DataFrame:
    """Pages ``doc_id, page_no, text`` without repeated lines; page numbers stay, a page may become empty.

    Counting is combined before the shuffle; the lines to drop are anti-joined, where adaptive execution splits a document
    that holds a large part of all lines. Null pages become empty.
    """
    return pages.select("doc_id", "page_no").distinct().join(_without_repeated(pages, times), ["doc_id", "page_no"], "left").fillna("", ["text"])


def _without_repeated(pages: DataFrame, times: int) -> DataFrame:
    """The pages that keep a line."""
    kept = page_lines(pages).join(repeated_lines(pages, times), ["doc_id", "line"], "left_anti")
    text = kept.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return text.select("doc_id", "page_no", F.array_join("l.line", "\n").alias("text"))


def drop_poor_pages(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """Pages with enough letters, as they were."""
    return pages.where(has_content("text", least))


def clean_documents(pages: DataFrame, part: int = PART) -> DataFrame:
    """``doc_id, part_no, text``: repeated lines out, poor pages out, pages joined in order and cleaned.

    Lines are counted over the whole document. A document with page numbers of ``part`` and more gives one text for each
    ``part`` page numbers, so that a task gathers that many pages at most, whatever share of all pages a document holds; the
    others have the one part 0. A document whose pages all go has no row; a null page number counts as part 0.
    """
    good = drop_poor_pages(_without_repeated(pages, REPEATED))
    number = F.floor(F.coalesce("page_no", F.lit(0)) / part).cast("int")
    joined = good.groupBy("doc_id", number.alias("part_no")).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return joined.select("doc_id", "part_no", clean(F.array_join("p.text", "\n")).alias("text"))
