import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(9_000))
PROSE = " ".join(f"alpha{i * i % 1009} beta{i * 7 % 613}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, PROSE, "a"), (1, PROSE, "a"), (2, PROSE, None), (3, PROSE + " more", "b"), (4, None, "a"), (5, "", "b"),
        (6, "  \n\t ", "b"), (None, PROSE, "a"), (None, None, None), (7, LONG, "a"), (8, "one two", "b"),
        (9, "line one is here\nline one is here\n\nline one is here", "a"),
        (9007199254740993, "an id that a double can't hold", "c"),
    ]
    own = ["key", "sid", "n", "component", "size", "taken", "place", "id", "line", "score", "n_lines", "label", "first"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(f"own {c}") for c in own})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
