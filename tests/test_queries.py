"""The driver's queries against their SQL at the smallest scale."""

import glob
import numbers
import os

import pytest

SF = "/root/testdata/sf0.001"


def names():
    import __spark_entry__ as e

    return sorted(n for n in e.oracle_sql() if not n.startswith("op") and n != "pipeline")


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    cell = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)
    return sorted(([cell(x) for x in r] for r in df.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(e.queries()[name](spark, SF).toPandas()) == rows(c.execute(e.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_operators(tmp_path):
    """Both llm folders and the pipeline deleted: the rest imports, and a
    missing module elsewhere isn't taken for them."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    ask = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    run = lambda: subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True)
    n, *rest = run().stdout.split()
    assert int(n) > 80 and rest == ["False", "False"]
    (copy / "evidentia" / "rules.py").unlink()
    assert "No module named 'evidentia.rules'" in run().stderr
