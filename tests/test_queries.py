"""Every query with SQL gives the SQL's rows at the smallest scale; the others give rows."""

import math
import os

import duckdb
import pytest

from tallyframe.plans import queries as own
from tallyframe.plans import queries_cases, queries_checks, queries_filings, queries_more, queries_research, queries_scores  # noqa: F401  (add their queries to own.QUERIES)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else f"{x:.6g}"
        if hasattr(x, "as_tuple"):
            return f"{float(x):.6g}"
        return x if x is None or isinstance(x, bool) else str(x)

    return sorted(map(str, ([one(r[i]) for i in order] for r in data)))




@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in own.ORACLE:
        assert got
        return
    want = duck.execute(own.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    floats = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    fixed = [tuple(float(v) if n in floats and v is not None else v for n, v in zip(names, r)) for r in want.fetchall()]
    assert rows(df.columns, got) == rows(names, fixed)
