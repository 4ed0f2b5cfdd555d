import re
from pathlib import Path

import pytest

SF = Path("/root/testdata")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    """A-Z only."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def sf():
    """Folder of a scale factor's tables."""

    def path(name):
        folder = SF / name
        if not folder.exists():
            pytest.skip("test tables are not here")
        return str(folder)

    return path


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) tuples, with extra columns whose names operators use for their own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, 2.0, "y") for r in rows]
        names = "doc_id long, text string, source string, row string, n int, score double, fp string"
        return spark.createDataFrame(full, names)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, a long one, ties and repeated rows."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(30_000))
    return [
        (1, "one text of some words, for a start. " * 20), (2, "one text of some words, for a start. " * 20), (3, None), (4, ""), (5, " \n\t \n"), (6, "a"),
        (7, long), (7, long), (8, "same id"), (8, "other text under the same id"), (None, "no id here"), (None, None), (None, "no id here"), (9, "é ß 東京 İ ﬁ"),
    ]
