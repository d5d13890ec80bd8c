import glob
import os
import pathlib
import shutil
import subprocess
import sys

import __spark_entry__ as entry
import duckdb
import pytest
from binfall.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() == 9


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, left):
    home = pathlib.Path(entry.__file__).parent
    shutil.copytree(home / "binfall", tmp_path / "binfall", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        shutil.copy(home / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES))] * 2, done.stderr


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: repr([r[c] for c in sorted(names)])
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))


def test_mean_of_counts_beyond_a_counter_equals_its_sql(spark, tmp_path):
    """More rows in a bucket than 64 bits hold of the weight."""
    made = f"COPY (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 50.0 ELSE 1234.56 END AS l_extendedprice FROM '{SF}/lineitem.parquet', range(4)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"
    c = duckdb.connect()
    c.execute(made)
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = c.execute(ORACLES["mean_large_counts"]).fetchall()
    assert c.execute("SELECT min(n) FROM (SELECT max(n) AS n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_extendedprice) GROUP BY l_returnflag)").fetchone()[0] * 10**16 > 2**64
    assert sorted(tuple(r) for r in QUERIES["mean_large_counts"](spark, str(tmp_path)).collect()) == sorted(want)
