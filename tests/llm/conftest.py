import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for folder in (ROOT, os.path.join(ROOT, "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with a clashing extra column, null ids and texts, empty and blank texts, repeats, a long text and ties."""
    base = "the quick brown fox jumps over the lazy dog while nine grey geese fly past an old stone mill by the river"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " today", "en", "b"), (4, None, "en", None), (5, "", None, "c"), (6, " \n\t ", "de", "c"),
        (7, "x", "en", "c"), (7, "x", "en", "c"), (None, base, "en", "a"), (None, None, None, None), (8, "Größe und Straße <|endoftext|> ÅΣ!! don't", "de", "d"),
        (9, " ".join(f"word{k % 977} tail{k % 31}" for k in range(9000)), "en", "e"), (10, "12345 !!! 678", "fr", "e"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, shard string")
