"""Every query of the governed part against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest
from sheafline.plans import governed, whole_runs  # noqa: F401

SF = Path("/root/testdata/sf0.001")
DUCK = duckdb.connect()
for _path in SF.glob("*.parquet"):
    DUCK.sql(f"CREATE VIEW {_path.stem} AS SELECT * FROM '{_path}'")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(governed.ORACLE_SQL))
def test_query(spark, name):
    got = governed.QUERIES[name](spark, str(SF))
    want = DUCK.sql(governed.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry_imports_without_the_other_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith(("sheafline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("sheafline.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(governed.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
