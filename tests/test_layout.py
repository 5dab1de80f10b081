import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "relayloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"relayloom\.llm|corpus_pipeline", f.read_text()), f


def test_entry_works_without_it(tmp_path):
    for name in ("__spark_entry__.py", "relayloom"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "relayloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'poll_pending' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_every_query_has_a_name_once():
    from relayloom.plans import queries

    assert set(queries.oracle_sql()) == set(queries.queries())
