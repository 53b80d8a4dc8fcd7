import os
import random
from pathlib import Path

import pytest

os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, size string, k string, run string, role string"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of({doc_id: text} or rows of (doc_id, text[, lang, source])): documents with extra columns of clashing names."""

    def make(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "a")[len(r) - 2 :])[:4]
            full.append((doc_id, text, lang, source, len(text or ""), "node", "size", "k", "run", "role"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, blanks only, a null id, repeated rows, ids given twice, a very long text, odd bytes."""
    long = prose(1, 60_000)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b "), (None, prose(2, 80)), (5, prose(2, 80)), (5, prose(2, 80)), (5, prose(3, 80)),
        (7, long), (8, long + " end"), (9, "one"), (10, "ONE"), (11, "x" * 3_000_000), (12, "é 漢字 \U0001f600 \x00 �"), (None, None),
    ]
