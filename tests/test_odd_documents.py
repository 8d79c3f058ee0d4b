"""Queries over documents against their SQL, with texts that hold what the small tables don't."""

import duckdb
import pytest

from tallyframe.plans import queries as own
from tallyframe.plans import queries_cases, queries_filings  # noqa: F401  (add their queries to own.QUERIES)

LONG = "words of a plain text that goes on and on for more than a hundred and twenty characters "
TEXTS = {
    0: "a b c d e f g h i j k l m n o p q r s t u v w x y z", 5: 'key = "2abc3ff2ca8fb1e4c565a0eb63815530" is told here and at no other place', 10: LONG[:75] + ' "quoted" ' + LONG, 15: LONG[:75] + ' "quoted" ' + LONG, 20: "short", 25: LONG * 2, 30: None,
    **{i: t for i, t in zip(range(31, 56), ["xghghgy", "an aro", "ñaro", "the landfill and its effluent spill", "Scope 3 legal proceedings on the environment", "hazardous waste", "gGHGhg", "CERCLA aro_GHG"] * 3)},
}


@pytest.mark.parametrize("name", ["agg_44_debt_footnotes", "fn_c07_topics"])
def test_odd_documents(spark, tmp_path, name):
    spark.createDataFrame(sorted(TEXTS.items()), "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(own.ORACLE[name])
    names = [d[0] for d in want.description]
    told = lambda r: tuple(f"{x:.6g}" if isinstance(x, float) else x for x in r)
    assert sorted(told(r[n] for n in names) for r in own.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(map(told, want.fetchall()))
