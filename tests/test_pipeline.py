import json

from larder.operators import chunking, cleaning, generation
from larder.plans import pipeline, sql_functions
from larder.sources import files
from larder.streaming import records

LONG = "Ein Satz über Eisen und Zink. " * 6


def test_files_to_answers(spark, tmp_path):
    table = json.dumps([["A", "B"], ["1", "2"]])
    for name, content in {"PDF/a.pdf": f"Kopf\n{LONG}\fKopf\n{LONG}\fKopf\nmehr Text", "PDF/bad.pdf": "BAD", "HTML/b.html": f"<body><article>{LONG}</article></body>", "PDF_table/c.pdf": table, "PDF_table/d.pdf": "[]"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(content)

    def pages(content):
        if content == b"BAD":
            raise ValueError("not a PDF")
        return content.decode().split("\f")

    def tables(content):
        found = json.loads(content)
        return [found] if found else []

    chunks = pipeline.chunks_of_files(files.scan_folders(spark, str(tmp_path)), pages, tables, f"file:{tmp_path}").collect()
    by = {r["metadata"]["source"]: r for r in chunks}
    assert set(by) == {"a.pdf", "bad.pdf", "b.html", "c.pdf"} and by["bad.pdf"]["error"] == "not a PDF" and by["bad.pdf"]["text"] is None
    assert "Kopf" not in by["a.pdf"]["text"] and by["a.pdf"]["metadata"]["folder"] == "PDF" and by["c.pdf"]["text"] == "| A | B |\n| --- | --- |\n| 1 | 2 |"
    queries = spark.createDataFrame([(1, "Eisen und Zink?"), (2, "")], "query_id bigint, query string")
    corpus = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(chunks) if r["text"]], "id bigint, text string")
    out = {r["query_id"]: r for r in pipeline.answers_to(queries, corpus).collect()}
    assert len(out) == 2 and "Eisen" in out[1]["contexts"][0] and len(out[1]["contexts"]) == 3 and out[1]["error"] is None

    async def broken(prompt):
        raise generation.ServiceError("down")

    assert all(r["answer"].startswith(generation.SERVICE_ERROR) for r in pipeline.answers_to(queries, corpus, generator=broken).collect())


def test_long_documents_come_in_parts(spark):
    """A document of many pages is gathered in parts; lines are counted over all of it."""
    rows = [(1, i, f"Kopf\nSeite {'abcdefghij'[i % 10] * (i + 1)} mit Text") for i in range(25)] + [(2, 0, "nur eine Seite"), (3, 5, "123"), (4, None, "ohne Nummer hier")]
    got = cleaning.clean_documents(spark.createDataFrame(rows, "doc_id bigint, page_no int, text string"), part=10).collect()
    assert sorted((r["doc_id"], r["part_no"]) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (4, 0)] and not any("Kopf" in r["text"] for r in got)
    assert sum(r["text"].count("Seite") for r in got if r["doc_id"] == 1) == 25


def test_settings(spark):
    spark.conf.set("larder.top_k", "7")
    try:
        made = pipeline.Settings.of(spark, {"LARDER_CHUNK_SIZE": "120", "LARDER_TOP_K": "9"})
    finally:
        spark.conf.unset("larder.top_k")
    assert made.top_k == 7 and made.chunk_size == 120 and made.in_flight == pipeline.Settings().in_flight


def test_functions_in_sql(spark):
    sql_functions.register(spark)
    row = spark.sql("SELECT main_text('<body><article>kurz</article></body>') a, decoded_text(unhex('41FF')) b, clean_text('x- y &amp; <b>z') c, composed_text('\u00b2') d, size(chunks_of(repeat('wort ', 1200))) e, main_text(null) f").first()
    assert row[:4] == ("kurz", "A", "xy & z", "2") and row["e"] == 3 and row["f"] == ""
    assert spark.sql("SELECT explode(chunks_of(null))").count() == 0


def test_chunks_keep_room_for_their_metadata(spark):
    df = spark.createDataFrame([(1, "wort " * 300, ("a b c", None)), (2, "wort " * 300, None)], "doc_id bigint, text string, metadata struct<source:string,folder:string>")
    got = chunking.chunk_documents(df, 100, 20, "metadata").collect()
    most = lambda i: max(chunking.count_tokens(r["text"]) for r in got if r["doc_id"] == i)
    assert most(1) == 100 - chunking.count_tokens("source: a b c") and most(2) == 100
    assert all(r["text"] for r in chunking.chunk_documents(df, 5, 20, "metadata").collect())


def test_streams(spark, tmp_path):
    rows = [(1, f"<p>{LONG}</p>", "2024-01-01 00:00:00"), (1, f"<p>{LONG}</p>", "2024-01-01 00:00:00"), (2, "1234 5678", "2024-01-01 00:01:00"), (3, None, "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id bigint, text string, at string").selectExpr("doc_id", "text", "timestamp(at) as at").repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id bigint, text string, at timestamp").parquet(str(tmp_path / "in"))
    query = records.into_table(records.chunked(source, 20, 5), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"] for r in out.collect()} == {1} and not out.where("text like '%<p>%'").count()
    query = records.first_deliveries(source, "doc_id", "at").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state2")).start()
    assert query.awaitTermination(60) and spark.table("once").count() == 3
    counted = records.counts(source, "at", "doc_id").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state3")).start()
    assert counted.awaitTermination(60) and {(r["doc_id"], r["n"]) for r in spark.table("counted").collect()} == {(1, 2), (2, 1), (3, 1)}
