"""The driver's contract, also where the corpus subpackage is gone."""

import importlib.util

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_without_the_corpus_subpackage(monkeypatch):
    real = importlib.util.find_spec

    def gone(name, *a):
        if name.startswith("weir.llm"):
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(entry.importlib.util, "find_spec", gone)
    names = entry.queries()
    assert "pipeline" not in names and not any(n.startswith("op") for n in names) and "q_pricing_summary" in names
