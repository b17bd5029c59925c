import __spark_entry__ as entry_module


def test_registry():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 45


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1


def test_core_stands_alone():
    """Nothing outside the subpackage for training data imports it."""
    import pathlib

    root = pathlib.Path(entry_module.__file__).parent / "larder"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "larder.llm" not in path.read_text() and "from larder import llm" not in path.read_text()
