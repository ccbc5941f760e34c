"""Every registered query of the engine against its SQL on the smallest tables."""

import decimal
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__  # noqa: E402
from tessera.plans import catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    r = db.execute(catalog.ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(row[cols.index(c)]) for c in sorted(cols)) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in sorted(cols)) for row in df.collect()) == want


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).schema.names
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and glob.glob(f"{SF}/*")
