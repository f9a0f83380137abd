"""Every registered query runs; those with SQL give what DuckDB gives."""

import pytest
from conftest import DATA, rows

from loam.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    made = registry.QUERIES[name](spark, DATA)
    columns = made.columns
    found = made.toPandas()
    if name in registry.ORACLE:
        wanted = duck.execute(registry.ORACLE[name]).df()
        assert sorted(columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()


def test_nothing_imports_the_training_subpackage():
    from pathlib import Path

    root = Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "loam.llm" not in p.read_text(), p
