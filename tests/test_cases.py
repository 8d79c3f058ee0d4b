"""Every case of the rule tables and scores, without a document around it."""

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import queries_cases, queries_more  # noqa: F401  (adds its cases)

CASES = queries_cases.CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    rows, operator = CASES[name]
    kinds = [next((type(case[i]) for case, _ in rows if case[i] is not None), str) for i in range(len(rows[0][0]))]
    names = {str: "string", int: "int", float: "double", bool: "boolean"}
    typed = [(n, *(kinds[i](v) if v is not None else None for i, v in enumerate(case))) for n, (case, _) in enumerate(rows)]
    df = spark.createDataFrame(typed, "n int, " + ", ".join(f"c{i} {names[k]}" for i, k in enumerate(kinds)))
    got = {r.n: r.answer for r in df.select("n", operator(*[F.col(f"c{i}") for i in range(len(kinds))]).alias("answer")).collect()}
    for n, (case, want) in enumerate(rows):
        assert got[n] == (pytest.approx(want) if isinstance(want, float) else want), case
