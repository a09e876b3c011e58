"""The driver's entry module imports whatever optional library is missing, and without Spark's archives at hand."""

import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
HIDE = "import sys, pathlib\nsys.modules[{missing!r}] = None\npathlib.Path.glob = lambda *a, **k: iter(())\nimport __spark_entry__ as e\nassert {query!r} in e.queries() and {query!r} in e.oracle_sql()\n"


@pytest.mark.parametrize("missing", ["tiktoken", "tokenizers", "zstandard", "xxhash", "regex", "numpy.random", "kgspark.llm", "corpus_pipeline"])
def test_imports_without(missing):
    said = subprocess.run([sys.executable, "-c", HIDE.format(missing=missing, query="lookup_exact")], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
