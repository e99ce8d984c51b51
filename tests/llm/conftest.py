import os
from pathlib import Path

import pytest

# Python workers of local mode look modules up from here.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, score double, rank int, n string"

LONG = " ".join(f"w{i % 977} the{i % 13}" for i in range(6_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank.", "", None, "   \n\t ", "one", "a b", "Ünïcödé — naïve 中文字符 text\nwith\x00null",
    LONG, LONG, "same line\nsame line\nsame line", "<s>[INST] ok </s> \\ back\\slash", "9876 !!! ###",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), "x", "y", 0.5, 1, "z") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, TEXTS[0], None, None, None, None, None, None, None, None), (None,) * 10, (4, "another text for id 4", "de", "s", 0, *[None] * 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
