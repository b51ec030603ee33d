"""Every registered query against its SQL on the smallest driver tables."""

import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from millrace.plans import ORACLES, QUERIES, run
from millrace.plans.registry import TABLES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def _comparable(records, names, wanted):
    at = [names.index(n) for n in wanted]
    plain = [tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in (r[i] for i in at)) for r in records]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = run(name, spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    wanted = sorted(names)
    assert _comparable(got.collect(), got.columns, wanted) == _comparable(result.fetchall(), names, wanted)


_WITHOUT = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r} or name in {hidden!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as driver
from millrace.plans import ORACLES, QUERIES
assert set(driver.queries()) == set(QUERIES) and set(driver.oracle_sql()) == set(ORACLES)
"""


@pytest.mark.parametrize("hidden", [["millrace.llm"], ["corpus_pipeline"], ["millrace.llm", "corpus_pipeline"], ["public_tokenizers"]])
def test_queries_without_the_corpus_operators(hidden):
    code = _WITHOUT.format(hidden=hidden)
    root = Path(driver.__file__).parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert driver.entry(spark).columns == ["c_custkey", "c_mktsegment", "TotalSales", "TransactionCount"]
    assert not driver.entry(spark).isEmpty()
