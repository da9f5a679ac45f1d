"""The driver's entry without the optional subpackage, or without a library that it needs."""

import sys

import __spark_entry__ as entry


def test_queries_without_the_optional_subpackage(monkeypatch):
    from fathom.plans import ORACLE, QUERIES

    monkeypatch.setitem(sys.modules, "fathom.llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)


def test_queries_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and "net_anomalies" in entry.queries()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
