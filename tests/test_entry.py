"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p7_found", "bm25_terms"} <= set(queries)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["collection", "path", "score", "doc_id"]


def test_without_the_subpackage(tmp_path):
    """A copy without it imports, and has the core's queries."""
    for source in [ROOT / "__spark_entry__.py", *(p for p in (ROOT / "larkspur").rglob("*.py") if "llm" not in p.parts)]:
        target = tmp_path / source.relative_to(ROOT)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p7_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k in ("HOME", "JAVA_HOME", "PATH")})


def test_only_the_subpackage_imports_itself():
    for path in (ROOT / "larkspur").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
