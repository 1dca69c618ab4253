import ast
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_package():
    for path in (REPO / "lanternfish").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
