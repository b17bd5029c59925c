"""The registered queries on the smallest tables: columns, whole results, and SQL where there is some."""

import pathlib

import duckdb
import pytest

from larder.llm.queries import registry

COLUMNS = {
    "p2_found": ["rec_id", "nutrient_id"],
    "p3_found": ["chunk_id_a", "chunk_id_b"],
    "p4_found": ["chunk_id", "line_no"],
    "p5_found": ["chunk_id", "line_no", "kind"],
    "p6_found": ["query_id", "defect"],
    "p7_found": ["chunk_id"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "kind", "value"],
}


@pytest.mark.parametrize("name", sorted(registry.runs))
def test_query(spark, sf_dir, name):
    out = registry.runs[name](spark, sf_dir)
    rows = out.collect()
    assert rows and out.columns == COLUMNS.get(name, out.columns)
    if name != "p8_ids" and name in COLUMNS:
        assert len(set(rows)) == len(rows)
    if name in registry.sql:
        connection = duckdb.connect()
        for path in pathlib.Path(sf_dir).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        assert sorted(map(tuple, rows)) == sorted(connection.execute(registry.sql[name]).fetchall())
