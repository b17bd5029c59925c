"""Queries of the preprocessing stage: scans, cleaning, tables, metadata, chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.page import decoded, page_text, page_text_by_density
from larder.operators import chunking, cleaning
from larder.plans.registry import Registry
from larder.sources import files, json_io, pdf
from larder.sources.tables import delivered, spread, table

registry = Registry()

#: Chunks once each, as SQL; the copy keeps struct fields out of the scan's filters.
CHUNKS = """chunks AS MATERIALIZED (SELECT chunk_id, doc_id, chunk_no, text, folder, doc_type, source FROM (
  SELECT chunk_id, doc_id, chunk_no, text, metadata.folder AS folder, metadata.doc_type AS doc_type, metadata.source AS source,
         row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) AS rn FROM all_chunks) WHERE rn = 1)"""
SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DIRT = "concat('see http://a.b/c?d=1 ', text, ' <b>x- y</b>  z&amp;')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"


SQL_LINES = r"regexp_split_to_array(text, '\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return delivered(spark, sf_dir, "all_chunks", "chunk_id", *columns)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "doc_id", "chunk_no", "text").select("doc_id", F.col("chunk_no").alias("page_no"), "text")


def _dirty(column: str = "text"):
    return F.concat(F.lit("see http://a.b/c?d=1 "), F.col(column), F.lit(" <b>x- y</b>  z&amp;"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")


@registry.add("scan_union_doc_types", "SELECT doc_id, path, doc_type FROM source_files WHERE (doc_type = 'PDF' AND suffix(path, '.pdf')) OR (doc_type = 'HTML' AND suffix(path, '.html')) OR (doc_type = 'PDF_table' AND suffix(path, '.pdf'))")
def scan_union_doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.of_types(table(spark, sf_dir, "source_files")).select("doc_id", "path", "doc_type")


@registry.add("filter_extension", "SELECT doc_id, path FROM source_files WHERE suffix(path, '.html')")
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").where(F.endswith("path", F.lit(".html"))).select("doc_id", "path")


@registry.add("build_metadata", r"SELECT doc_id, regexp_replace(substr(path, length('richtlinien/') + 1), '/?[^/]*$', '') AS folder, doc_type, regexp_extract(path, '([^/]*)$', 1) AS source FROM source_files")
def build_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = table(spark, sf_dir, "source_files").select("doc_id", files.metadata_of("path", "doc_type", "richtlinien").alias("m"))
    return built.select("doc_id", "m.folder", "m.doc_type", "m.source")


@registry.add("strip_urls", f"SELECT doc_id, regexp_replace({DIRT}, 'http[^{SPACE}]+', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def strip_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.strip_urls(_dirty()).alias("text"))


@registry.add("strip_tags", f"SELECT doc_id, regexp_replace({DIRT}, '<[^>]+>', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.strip_tags(_dirty()).alias("text"))


@registry.add("dehyphenate", rf"SELECT doc_id, regexp_replace({DIRT}, '([\p{{L}}\p{{N}}_])-[{SPACE}]+([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS text FROM documents WHERE text IS NOT NULL")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.dehyphenate(_dirty()).alias("text"))


@registry.add("collapse_ws", f"SELECT doc_id, {sql_collapse(DIRT)} AS text FROM documents WHERE text IS NOT NULL")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.collapse_space(_dirty()).alias("text"))


@registry.add("basic_clean")
def basic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.clean("text").alias("text"))


@registry.add("filter_low_content", rf"""WITH {CHUNKS}, p AS (SELECT chunk_id, text, {sql_strip('text')} AS s FROM chunks)
SELECT chunk_id FROM p WHERE length(s) > 0 AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= 0.5 * length(s)""")
def filter_low_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_poor_pages(spread(table(spark, sf_dir, "all_chunks").select("chunk_id", "text"))).select("chunk_id").distinct()


_KEPT_LINES = f"""split AS (SELECT doc_id, chunk_no AS page_no, unnest({SQL_LINES}) AS raw, generate_subscripts({SQL_LINES}, 1) AS line_no FROM chunks WHERE text IS NOT NULL),
lines AS (SELECT doc_id, page_no, line_no, {sql_collapse('raw')} AS line FROM split),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n FROM lines WHERE line <> '')"""


@registry.add("repeated_lines", f"WITH {CHUNKS}, {_KEPT_LINES} SELECT doc_id, line, count(*) AS n FROM counted WHERE n >= 3 GROUP BY doc_id, line")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_lines(pages(spark, sf_dir))


@registry.add("remove_repeated_lines", f"""WITH {CHUNKS}, {_KEPT_LINES},
built AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM counted WHERE n < 3 GROUP BY doc_id, page_no)
SELECT p.doc_id, p.page_no, coalesce(b.text, '') AS text FROM (SELECT DISTINCT doc_id, chunk_no AS page_no FROM chunks) p LEFT JOIN built b ON p.doc_id = b.doc_id AND p.page_no = b.page_no""")
def remove_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.remove_repeated_lines(pages(spark, sf_dir))


@registry.add("pdf_clean_pipeline")
def pdf_clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one cleaned text, a long one as several; a document whose pages all go has no row."""
    pdf = chunks(spark, sf_dir, "doc_id", "chunk_no", "text", "metadata").where("metadata.doc_type = 'PDF'").select("doc_id", F.col("chunk_no").alias("page_no"), "text")
    return cleaning.clean_documents(pdf)


@registry.add("decode_bytes", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read back from bytes, each with an invalid byte at its start and end."""
    invalid = F.unhex(F.lit("FF"))
    content = F.concat(invalid, F.encode("text", "UTF-8"), invalid)
    return _texts(spark, sf_dir).select("doc_id", decoded(content).alias("text"))


@registry.add("unescape_compose", "SELECT doc_id, doc_type || ' & fi 2 ' || chr(956) || 'g <b> 1 Aß' AS text FROM documents")
def unescape_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities resolved once and compatibility forms composed."""
    dirty = F.concat("doc_type", F.lit(" &amp; \ufb01 \u00b2 \u00b5g &lt;b&gt;\u00a0\uff11 A&szlig;"))
    return table(spark, sf_dir, "documents").select("doc_id", T.unescape_and_compose(dirty).alias("text"))


_PROSE = "repeat('Absatz ' || doc_id || ' mit Text. ', 12)"


@registry.add("html_tiers", f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN trim({_PROSE}) WHEN 1 THEN 'Kopf ' || trim({_PROSE}) WHEN 2 THEN 'kurz ' || trim({_PROSE}) WHEN 3 THEN 'knapp' WHEN 4 THEN 'Titel ' || trim({_PROSE}) ELSE '' END AS text FROM documents""")
def html_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each way to the main content: article, captured source, body, last short container, whole page, none."""
    prose = F.expr(_PROSE)
    captured = F.concat(F.lit("&lt;!DOCTYPE html&gt;&lt;html&gt;&lt;title&gt;Kopf&lt;/title&gt;&lt;nav&gt;Start&lt;/nav&gt;&lt;p&gt;"), prose, F.lit("&lt;/p&gt;&lt;/html&gt;"))
    page = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("<body><nav>Start</nav><article><script>x()</script><p>"), prose, F.lit("</article><footer>Ende</footer></body>")))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("<body><p>davor</p><pre>"), captured, F.lit("</pre></body>")))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("<body><article>kurz</article><p>"), prose, F.lit("</p><button>Los</button></body>")))
        .when(F.col("doc_id") % 6 == 3, F.lit("<article>kurz</article><main>knapp</main>"))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("<title>Titel</title><div>"), prose, F.lit("<!-- nie --></div>")))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "documents").select("doc_id", page_text(page).alias("text"))


@registry.add("html_dense", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Titel ' || doc_id || chr(10) || trim({_PROSE}) || chr(10) || 'kurz dazwischen' || chr(10) || trim({_PROSE}) WHEN 1 THEN trim({_PROSE}) ELSE 'nur kurz' END AS text FROM documents""")
def html_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running text by density: link lists, tables and captions go, headings and short blocks inside stay; poor pages fall back."""
    prose = F.expr(_PROSE)
    links = F.lit("<div><a href='x'>Ein Link mit einem längeren Titel</a> <a href='y'>Noch ein Link mit einem längeren Titel</a></div>")
    page = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(links, F.lit("<h1>Titel "), F.col("doc_id"), F.lit("</h1><p>"), prose, F.lit("</p><p>kurz <b>dazwischen</b></p><p>"), prose, F.lit("</p>"), links))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<nav>"), links, F.lit("</nav><table><tr><td>"), prose, F.lit("</td></tr></table><div>"), prose, F.lit("<!-- nie --></div><p>Fuß</p>")))
        .otherwise(F.lit("<body><p>nur kurz</body>"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", page_text_by_density(page).alias("text"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("<html><head><title>"), F.col("doc_type"), F.lit("</title></head><body><nav>Start</nav><article><p>"))
    body = F.concat(title, F.regexp_replace("text", "\n", "</p><p>"), F.lit("</article><footer>&copy; Larder</footer></body></html>"))
    return spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "doc_type", "text")).select("doc_id", body.alias("html"))


@registry.add("html_clean")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html(spark, sf_dir).select("doc_id", page_text("html").alias("text"))


@registry.add("html_clean_pipeline")
def html_clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html(spark, sf_dir).select("doc_id", T.clean(page_text("html")).alias("text"))


_TABLE_SQL = """SELECT n_regionkey, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || trim(n_name) || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), F.col("n_name"))).alias("cells"))))
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("r"))
    return grouped.select("n_regionkey", F.concat(F.array(F.array(F.lit("key"), F.lit(" nation"))), F.col("r.cells")).alias("cells"))


@registry.add("table_markdown", _TABLE_SQL)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("n_regionkey", T.markdown_table("cells").alias("markdown"))


@registry.add("table_pipeline", f"WITH t AS ({_TABLE_SQL}) SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN '' ELSE coalesce(markdown || chr(10) || chr(10) || markdown, '') END AS text FROM region LEFT JOIN t ON r_regionkey = n_regionkey")
def table_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a document, joined by a blank line; none give an empty text."""
    tables = _cells(spark, sf_dir).select("n_regionkey", F.array(T.markdown_table("cells"), T.markdown_table("cells")).alias("tables"))
    joined = table(spark, sf_dir, "region").join(tables, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    given = F.when(F.col("r_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.col("tables"))
    return joined.select("r_regionkey", F.coalesce(F.array_join(F.filter(given, lambda x: x.isNotNull()), "\n\n"), F.lit("")).alias("text"))


def _sheets(spark: SparkSession, sf_dir: str, page: Callable[[list], list]) -> DataFrame:
    """One PDF of the nations of each region: ``path, content``."""

    @F.pandas_udf("binary")
    def made(nations: pd.Series) -> pd.Series:
        return nations.map(lambda rows: pdf.simple_pdf(page([(r["n_nationkey"], r["n_name"]) for r in rows])))

    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("r")).select(F.col("n_regionkey").cast("string").alias("path"), made("r").alias("content"))


@registry.add("pdf_pages", "SELECT n_regionkey::VARCHAR AS path, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS page_no, trim(n_name) || chr(10) || 'Nr. ' || n_nationkey AS text FROM nation")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of PDFs, read back: one page a nation."""
    sheets = _sheets(spark, sf_dir, lambda rows: [([(50, 800, name.strip()), (50, 780, f"Nr. {key}")], []) for key, name in rows])
    return files.read_pages(sheets, pdf.pages).select("path", "page_no", "text")


def _ruled(rows: list) -> list:
    cells = [("key", "nation"), *rows]
    texts = [(54 + 100 * j, 786 - 20 * i, str(c).strip()) for i, row in enumerate(cells) for j, c in enumerate(row)]
    across = [(50, 800 - 20 * i, 250, 800 - 20 * i) for i in range(len(cells) + 1)]
    return [(texts, across + [(50 + 100 * j, 800, 50 + 100 * j, 800 - 20 * len(cells)) for j in range(3)])]


@registry.add("pdf_tables", _TABLE_SQL.replace("SELECT n_regionkey,", "SELECT n_regionkey::VARCHAR AS path,"))
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ruled tables of PDFs, read back as Markdown: one table a region."""
    found = files.read_pages(_sheets(spark, sf_dir, _ruled), lambda content: [json.dumps(t) for t in pdf.tables(content)])
    return found.select("path", T.markdown_table(F.from_json("text", "array<array<string>>")).alias("markdown"))


@registry.add("chunk_words", """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 60) / 48.0), 0) AS BIGINT) + 1)) AS chunk_no FROM w WHERE len(w) > 0)
SELECT doc_id, chunk_no, array_to_string(list_slice(w, chunk_no * 48 + 1, chunk_no * 48 + 60), ' ') AS text FROM c""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 60 words every 48, so that most texts have several."""
    return chunking.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "text"), 60, 48)


@registry.add("chunk_text")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-aware chunks with their document's metadata, which counts; at most 120 tokens, at most 24 of them shared."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.struct("source", "doc_type").alias("metadata")))
    return chunking.chunk_documents(documents, 120, 24, "metadata").select("doc_id", "chunk_no", "text", "metadata.source", "metadata.doc_type")


@registry.add("chunk_counts", f"WITH {CHUNKS} SELECT doc_type, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM chunks GROUP BY doc_type")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "all_chunks").select(F.col("metadata.doc_type").alias("doc_type"), "doc_id", "chunk_id").distinct()
    by_doc = typed.groupBy("doc_type", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("doc_type").agg(F.sum("n").alias("chunks"), F.count("*").alias("documents"))


@registry.add("chunks_json_roundtrip", f"WITH {CHUNKS} SELECT text, folder, doc_type, source, count(*) AS n FROM chunks GROUP BY ALL")
def chunks_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = json_io.scratch_path(spark, "chunks")
    json_io.write_lines(json_io.chunk_rows(chunks(spark, sf_dir, "text", "metadata")), path)
    back = json_io.read_lines(spark, path, json_io.CHUNK)
    return back.select("text", "metadata.folder", "metadata.doc_type", "metadata.source").groupBy("text", "folder", "doc_type", "source").agg(F.count("*").alias("n"))
