"""The driver's contract."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 200"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 6 and "literals" in df.columns


def test_nothing_else_imports_the_corpus_package():
    for p in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "plumbline").parts[:1]:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", p.read_text(encoding="utf-8"))
