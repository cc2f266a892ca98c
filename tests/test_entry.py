"""Every query of the links equals its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from linkloom import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = entry_module.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    result = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(result.columns) == cols
    want = result.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want)


def test_entry(spark):
    df = entry_module.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and plan.count("FileScan") == 1 and "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert df.count() > 0


def test_without_llm():
    """The entry module lives without the training-data subpackage."""
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('linkloom.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = list(e.queries())\n"
        "assert names and not any(n.startswith('op') or n == 'pipeline' for n in names), names\n"
    )
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
