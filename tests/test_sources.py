import json

import pytest
from pyspark.sql import functions as F

from larder.functions.page import decoded
from larder.operators.retrieval import hash_embedding
from larder.sources import files, json_io, tables, vectors
from larder.sources.tables import bounded_rows, first_delivery


def test_scan_folders(spark, tmp_path):
    for name, content in {"PDF/a.pdf": b"1", "PDF/b.PDF": b"2", "PDF/c.txt": b"3", "HTML/d.html": b"x\xffy", "PDF_table/e.pdf": b"4"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    found = files.scan_folders(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in found.withColumn("text", decoded("content")).collect()}
    assert set(got) == {"a.pdf", "d.html", "e.pdf"} and got["d.html"]["text"] == "xy" and got["e.pdf"]["doc_type"] == "PDF_table"
    pages = files.read_pages(found, lambda b: [b.decode(), "zwei"]).collect()
    assert sum(r["error"] is not None for r in pages) == 1 and sum(r["page_no"] == 1 for r in pages) == 2
    with pytest.raises(Exception):
        files.scan_folders(spark, str(tmp_path / "missing")).count()


def test_metadata(spark):
    df = spark.createDataFrame([("root\\PDF\\x\\a.pdf",), ("root/b.html",), ("other/c.html",), (None,)], "path string")
    got = [tuple(r["m"]) for r in df.select(files.metadata_of("path", F.lit("T"), "root").alias("m")).collect()]
    assert got == [("PDF/x", "T", "a.pdf"), ("", "T", "b.html"), (None, "T", "c.html"), (None, "T", None)]


def test_json(spark, tmp_path):
    rows = [("Öl\n", ("f", "PDF", None)), (None, (None, None, None)), ("", ("g", "HTML", "s"))]
    df = spark.createDataFrame(rows, json_io.CHUNK)
    json_io.write_lines(df, str(tmp_path / "lines"))
    assert sorted(map(str, json_io.read_lines(spark, str(tmp_path / "lines"), json_io.CHUNK).collect())) == sorted(map(str, df.collect()))
    target = tmp_path / "array.json"
    assert json_io.export_array(df, str(target)) == 3 and "Öl" in target.read_text() and len(json.loads(target.read_text())) == 3
    assert json_io.read_array(spark, str(target), json_io.CHUNK).count() == 3
    assert json_io.export_array(df.where("false"), str(target)) == 0 and json.loads(target.read_text()) == []


def test_vector_index_follows_its_chunks(spark, tmp_path):
    a = spark.createDataFrame([(1, "Eisen"), (2, "Zink")], "chunk_id bigint, text string")
    b = spark.createDataFrame([(1, "Eisen"), (2, "Jod")], "chunk_id bigint, text string")
    assert vectors.content_key(a) == vectors.content_key(a.orderBy(F.desc("chunk_id"))) != vectors.content_key(b)
    first = vectors.load_or_build(spark, a, str(tmp_path), hash_embedding).count()
    again = vectors.load_or_build(spark, a, str(tmp_path), lambda c: F.array().cast("array<double>")).where(F.size("vector") == 64).count()
    other = vectors.load_or_build(spark, b, str(tmp_path), hash_embedding)
    assert first == again == other.count() == 2 and len(list(tmp_path.iterdir())) == 2


def test_first_delivery(spark):
    rows = [(1, "b", 2), (1, "a", 1), (2, "c", None), (2, "d", 5), (None, "e", 1), (None, "e", 1)]
    got = first_delivery(spark.createDataFrame(rows, "id bigint, x string, loaded_at int"), "id").collect()
    assert sorted(((r["id"] or 0), r["x"]) for r in got) == [(0, "e"), (1, "a"), (2, "d")]
    assert bounded_rows(spark.range(5), 4) is None and len(bounded_rows(spark.range(4), 4)) == 4
    long = spark.createDataFrame([("x" * 100,)] * 3, "text string")
    assert bounded_rows(long, 4, 299) is None and len(bounded_rows(long, 4, 300)) == 3 and bounded_rows(long.where("false"), 4) == []


def test_spread(spark):
    assert tables.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4 and tables.spread(spark.range(10).repartition(9)).rdd.getNumPartitions() == 9


def test_retriever_is_opened_once(spark, tmp_path):
    a = spark.createDataFrame([(1, "Eisen")], "chunk_id bigint, text string")
    b = spark.createDataFrame([(1, "Eisen"), (2, "Jod")], "chunk_id bigint, text string")
    assert vectors.retriever(spark, a, str(tmp_path), hash_embedding) is vectors.retriever(spark, b, str(tmp_path), hash_embedding)
    assert vectors.retriever(spark, b, str(tmp_path), hash_embedding, again=True).count() == 2


def test_scratch_is_marked_for_deletion(spark):
    path = json_io.scratch_path(spark, "x")
    spark.range(1).write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    assert target.getFileSystem(spark._jsc.hadoopConfiguration()).cancelDeleteOnExit(target)
