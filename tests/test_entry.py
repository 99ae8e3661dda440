"""The driver's contract: names, SQL and what is left without the corpus subpackage."""

import importlib
import sys

import __spark_entry__ as entry
from thermagrid.plans import queries


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_the_flagship_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["d", "r", "c", "lst"] and got.count() > 0


def test_the_rest_stands_without_the_corpus_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("thermagrid.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "thermagrid.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    try:
        assert set(alone.queries()) == set(queries.QUERIES) and set(alone.oracle_sql()) == set(queries.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
