import random

import pytest
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.page import main_text
from larder.operators import chunking, cleaning

CLEAN = [
    ("a  b\n\tc", "a b c"),
    ("see https://x.y/z). End", "see End"),
    ("httpfoo bar", "bar"),
    ("http", "http"),
    ("<p>Hi<br>there</p>", "Hi there"),
    ("&lt;b&gt;x&lt;/b&gt;", "<b>x</b>"),
    ("&amp;lt;", "&lt;"),
    ("20 µg&nbsp;pro Tag", "20 μg pro Tag"),
    ("Ernäh-\n rung", "Ernährung"),
    ("a- b- c", "ab- c"),
    ("A- und B", "Aund B"),
    ("< 10 g und > 5 g", "5 g"),
    ("ﬁt ½", "fit 1⁄2"),
    ("x\u001cy", "x y"),
    ("", ""),
    (None, None),
]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r["x"] for r in df.select("i", make("text").alias("x")).orderBy("i").collect()]


def test_clean(spark):
    assert column(spark, [a for a, _ in CLEAN], T.clean) == [b for _, b in CLEAN]
    assert [T.clean_text(a) for a, _ in CLEAN] == [b for _, b in CLEAN]


def test_clean_agrees_with_python(spark):
    chosen = random.Random(3)
    alphabet = "ab1 \t\n\r-<>&;\u001c  ﬁµäß|." + "http"
    texts = ["".join(chosen.choice(alphabet) for _ in range(chosen.randrange(60))) + chosen.choice(["", "&amp; x- y", "<i>z</i>", "http://q w"]) for _ in range(300)]
    assert column(spark, texts, T.clean) == [T.clean_text(t) for t in texts]


def test_has_content(spark):
    values = ["", " \n", "abc1", "ab12", "a1234", "ä\U0001f600", "  a1  ", None]
    assert column(spark, values, T.has_content) == [False, False, True, True, False, True, True, False]


@pytest.mark.parametrize(
    ("pages", "expected"),
    [
        (["H\nx", "H\ny", "H\nz"], ["x", "y", "z"]),
        (["H\nx", "H\ny"], ["H\nx", "H\ny"]),
        (["H\nH\n H \nx"], ["x"]),
        (["a  b", "a\tb", " a b "], ["", "", ""]),
        (["h", "H", "h"], ["h", "H", "h"]),
        (["x\r\n\r\ny"], ["x\ny"]),
        ([None, ""], ["", ""]),
    ],
)
def test_repeated_lines(spark, pages, expected):
    df = spark.createDataFrame([(7, i, p) for i, p in enumerate(pages)], "doc_id bigint, page_no int, text string")
    assert [r["text"] for r in cleaning.remove_repeated_lines(df).orderBy("page_no").collect()] == expected


def test_markdown(spark):
    df = spark.createDataFrame([(0, [[" A ", "B"], ["1", " 2"]]), (1, [["A"]]), (2, []), (3, None)], "i int, cells array<array<string>>")
    got = [r["x"] for r in df.select("i", T.markdown_table("cells").alias("x")).orderBy("i").collect()]
    assert got == ["| A | B |\n| --- | --- |\n| 1 | 2 |", "| A |\n| --- |", None, None]


def test_numbers(spark):
    got = column(spark, ["no digits", "1.5 mg", "-60", "007 und 80", "9" * 40, None], T.numbers)
    assert [None if x is None else [None if v is None else int(v) for v in x] for x in got] == [[], [1, 5], [60], [7, 80], [None], None]


LONG = "Ein Satz über Eisen. " * 8


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body><nav>Nav</nav><article><p>{LONG}<b>fett</article><footer>F</footer></body>", LONG.strip() + " fett"),
        (f"<body><article>kurz</article><p>{LONG}</p></body>", "kurz " + LONG.strip()),
        ("<article>zehn</article><main>zwanzig</main>", "zwanzig"),
        (f"<p>x</p><pre>&lt;!DOCTYPE html&gt;&lt;html&gt;&lt;title&gt;T&lt;/title&gt;&lt;nav&gt;N&lt;/nav&gt;&lt;p&gt;{LONG}&lt;/p&gt;&lt;/html&gt;</pre>", "T " + LONG.strip()),
        ("<html><title>Titel</title><p>Text</p></html>", "Titel Text"),
        ("<script>'</p>'</script><p>a<p>b", "a b"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, expected):
    assert main_text(page) == expected


def test_split_text():
    assert chunking.split_text(None) == chunking.split_text(" \n") == []
    text = " ".join(f"Satz {i} nennt {i * 3} Gramm, also etwas mehr." for i in range(400))
    for size, overlap in ((50, 10), (120, 24), (500, 100)):
        pieces = chunking.split_text(text, size, overlap)
        assert all(0 < chunking.count_tokens(p) <= size for p in pieces) and pieces == chunking.split_text(text, size, overlap)
        at = 0
        for before, piece in zip(["", *pieces], pieces):
            start = text.index(piece[:30], max(0, at - len(before)))
            assert not text[at:start].strip()
            shared = text[start:at]
            assert chunking.count_tokens(shared) <= overlap
            at = start + len(piece)
        assert not text[at:].strip()
    assert all(chunking.count_tokens(p) <= 20 for p in chunking.split_text("wort" * 1 + " x" * 500, 20, 5))


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "Ein Satz. " * 100, "s"), (2, None, "s"), (3, "", "t")], "doc_id bigint, text string, source string")
    rows = chunking.chunk_documents(df, 60, 12).orderBy("chunk_no").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_no"] for r in rows] == list(range(len(rows))) and rows[0]["source"] == "s"
    words = chunking.chunk_words(spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, ""), (3, None)], "doc_id bigint, text string"))
    got = {r["chunk_no"]: r["text"].split(" ") for r in words.collect()}
    assert len(got) == 3 and got[1][0] == "400" and len(got[2]) == 200


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, page_no int, text string")
    assert cleaning.remove_repeated_lines(empty).count() == cleaning.clean_documents(empty).count() == chunking.chunk_words(empty).count() == 0
    assert empty.select(T.strip(F.col("text"))).count() == 0
