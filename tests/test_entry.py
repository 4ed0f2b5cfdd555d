"""The entry point with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; from catalog.queries import QUERIES; assert set(QUERIES) <= set(e.queries()); print(len(e.queries()) > len(QUERIES))"


def shown(before: str = "") -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", f"{before}\n{SHOW}"], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("absent", ["claimweave.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_without_the_operators(absent):
    done = shown(f"import sys; sys.modules[{absent!r}] = None")
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "False" and "without the training-data operators" in done.stderr


def test_core_queries_need_no_library_of_the_operators():
    done = shown("import sys\nfor name in ('xxhash', 'tokenizers', 'sentencepiece', 'public_tokenizers', 'claimweave.llm'): sys.modules[name] = None")
    assert done.returncode == 0, done.stderr
