import importlib


def test_entry_flagship_on_smallest_tables(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["sub_category", "src", "dst", "weight"]
    assert df.count() == 42          # FIXTURES.md: edges after the cut at sf0.001
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
