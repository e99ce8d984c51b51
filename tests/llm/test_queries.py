"""The registered queries over tables with further columns of clashing names, and from another folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from txflow.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CLASHING = ("n_turns", "url", "quality", "language", "size", "_row", "text", "x", "doc_id", "component", "_before", "conv", "item", "score")


@pytest.fixture(scope="module")
def crowded(spark, sf, tmp_path_factory):
    """The tables with all of these columns, where they do not have them."""
    folder = tmp_path_factory.mktemp("crowded")
    for name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        more = [c for c in CLASHING if c not in df.columns]
        df.withColumns({c: F.lit("other") for c in more}).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_further_columns_change_nothing(spark, sf, crowded, name):
    plain, found = (queries.QUERIES[name](spark, folder) for folder in (sf, crowded))
    assert plain.schema == found.schema
    # Sums of doubles depend on the order of rows in the last digits, the places of packed documents on the layout of files.
    key = [c for c, kind in plain.dtypes if not kind.startswith(("double", "array", "struct"))] if name != "op8_packing" else ["doc_id", "doc_tokens"]
    one, two = ({tuple(r) for r in df.select(key).collect()} for df in (plain, found))
    assert one == two and one


def test_workers_find_the_package_from_any_folder(tmp_path, sf):
    repo = Path(__file__).resolve().parents[2]
    code = (f"import sys; sys.path.insert(0, {str(repo)!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
            f"print('rows', e.queries()['op3_chat_examples'](spark, {sf!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "rows" in done.stdout, done.stderr[-2000:]
