"""Every core query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from larder.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    import pathlib

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.runs()))
def test_query(spark, db, sf_dir, name):
    out = catalog.runs()[name](spark, sf_dir)
    columns = sorted(out.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in out.collect())
    if name in catalog.sql():
        relation = db.execute(catalog.sql()[name])
        names = [d[0] for d in relation.description]
        assert sorted(names) == columns
        expected = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in relation.fetchall())
        assert rows == expected
    else:
        assert rows
