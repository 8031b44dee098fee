"""The entry stands without the corpus operators, and nothing else imports them."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
sys.modules["ledgerfold.llm"] = None
import __spark_entry__ as e
names = e.queries()
assert "fold_runs" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "ledgerfold").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path
