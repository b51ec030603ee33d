"""Small tables and the driver's views for the tests of the corpus operators."""

from pathlib import Path

import duckdb
import pytest

from millrace.llm.common import prepare

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("documents", "embeddings", "pages", "labels", "benchmark")


@pytest.fixture(scope="session")
def session(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("driver tables not present")
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con
