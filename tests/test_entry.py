import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    """The library, its entry and its queries live without docloom.llm and the pipeline."""
    for name in ("docloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)


def _copy(source, target):
    import shutil

    shutil.copytree(source, target, ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "docloom.llm" not in p.read_text(), p
