"""The driver's entry: names agree, and the image engine stands without the optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__
from quillframe.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "quillframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert not any(n.startswith("quillframe.llm") for n in names), path
