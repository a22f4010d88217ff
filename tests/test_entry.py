"""The driver contract: it imports, and its flagship query and its SQL go together."""

import __spark_entry__ as entry


def test_contract():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "recent_context" in names


def test_flagship(spark):
    assert entry.entry(spark).columns == ["session_id", "seq", "role", "text"]


def test_without_the_training_operators(monkeypatch):
    """Without the subpackage the other queries are all there; an import that fails inside it isn't hidden."""
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert entry._operators() is None

    def gone(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(entry, "find_spec", gone)
    assert entry._operators() is None
    monkeypatch.setattr(entry, "llm", None)
    assert "recent_context" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
