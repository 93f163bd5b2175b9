"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vigilake.plans import catalog  # noqa: F401
from vigilake.plans.registry import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return made


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(cell(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", [k for k, (_, sql) in REGISTRY.items() if sql])
def test_query(spark, db, name):
    function, sql = REGISTRY[name]
    df = function(spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(sql)
    assert got == table([x[0] for x in found.description], found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.entry(spark).columns) == {"scan_id", "score", "verdict", "alert_tag"}
