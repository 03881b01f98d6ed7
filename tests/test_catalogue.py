"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rosterflow.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v)[:19] if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    theirs = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in result.fetchall()), key=repr)
    assert columns == sorted(names)
    assert ours == theirs
