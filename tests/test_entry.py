"""The driver's contract."""

import duckdb

import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and [f.name for f in df.schema] == ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "net"]
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 60 and set(oracle) <= set(queries)
    for name, sql in oracle.items():
        assert duckdb.extract_statements(sql), name


def test_imports_stop_at_the_subpackage():
    """Nothing outside llm names it, but the entry."""
    for path in entry.ROOT.glob("sluice/**/*.py"):
        if "llm" not in path.parts:
            assert "sluice.llm" not in path.read_text(), path
