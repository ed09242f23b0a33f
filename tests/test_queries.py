"""Registered queries against their DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF)) if f.endswith(".parquet")] if os.path.isdir(SF) else []


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in registry.ORACLES:
        result = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_entry_imports_without_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("ledgerline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import ledgerline

    monkeypatch.delattr(ledgerline, "llm", raising=False)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("ledgerline.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    again = importlib.reload(entry)
    assert not any(n.startswith("op") for n in again.queries())
    assert set(registry.QUERIES) <= set(again.queries())
    monkeypatch.undo()
    importlib.reload(entry)
