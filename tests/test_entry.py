import re


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert {r["severity"] for r in entry.entry(spark).collect()} == {"CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    import basalt

    root = Path(basalt.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(?:basalt|from)\s*\.\s*llm|corpus_pipeline", path.read_text()), path
