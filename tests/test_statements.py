"""Hand-computed cases of the statement compiler."""

from pyspark.sql import functions as F

from tallyframe.operators import statements as st
from tallyframe.plans.compile import compile_statements

FACTS = "stmt string, row_id string, concept string, period string, file string, pos long, value double"
FILES = "file string, recency int"


def facts(spark, rows):
    return spark.createDataFrame([("income_statement", "r", *r) for r in rows], FACTS)


def files(spark):
    return spark.createDataFrame([("old", 0), ("mid", 1), ("new", 2)], FILES)


def cell(spark, rows):
    return st.newest_value(st.bucket_values(facts(spark, rows)), files(spark)).collect()


def test_newest_source_wins_and_conflicts_show(spark):
    (r,) = cell(spark, [("a", "1Q20", "old", 0, 100.0), ("a", "1Q20", "mid", 0, 150.0), ("a", "1Q20", "new", 0, 200.0)])
    assert (r.value, r.file, r.is_conflict) == (200.0, "new", True)
    (r,) = cell(spark, [("a", "1Q20", "old", 0, 100.0), ("a", "1Q20", "new", 0, 100.0)])
    assert (r.value, r.file, r.is_conflict) == (100.0, "new", False)


def test_several_concepts(spark):
    for values, want, method in (([30.0, 50.0, 80.0], 80.0, "reported"), ([30.3, 50.1, 80.0], 80.0, "reported"), ([50.0, 30.0], 80.0, "summed_within_file"), ([30.0, 30.0], 30.0, "reported")):
        (r,) = cell(spark, [(f"c{i}", "1Q20", "old", i, v) for i, v in enumerate(values)])
        assert (r.value, r.method) == (want, method)
    masters = spark.createDataFrame([("income_statement", "r", "c1")], "stmt string, row_id string, master_concept string")
    (r,) = st.bucket_values(facts(spark, [("c0", "1Q20", "old", 0, 5.0), ("c1", "1Q20", "old", 1, 7.0)]), masters).collect()
    assert r.value == 7.0


def test_newer_file_of_nulls_wins_then_gaps_are_filled(spark):
    f = facts(spark, [("a", "1Q20", "old", 0, 10.0), ("a", "1Q20", "new", 0, None)])
    buckets = st.bucket_values(f)
    assert buckets.count() == 1  # a file without values gives no value
    (r,) = compile_statements(f, files(spark)).collect()
    assert (r.period, r.value) == ("1Q20", 10.0)


def derived(spark, stmt, cells):
    rows = [(stmt, "r", p, float(v), "reported") for p, v in cells.items()]
    out = st.derive(spark.createDataFrame(rows, "stmt string, row_id string, period string, value double, method string"))
    return {r.period: (r.value, r.how) for r in out.collect()}


def test_derivations(spark):
    assert derived(spark, "income_statement", {"FY20": 400, "1Q20": 90, "2Q20": 100, "4Q20": 1})["4Q20"] == (210.0, "derived")
    cash = derived(spark, "cash_flow", {"1Q20": 10, "6M20": 25, "9M20": 45, "FY20": 70})
    assert [cash[f"{q}Q20"] for q in (2, 3, 4)] == [(15.0, "derived"), (20.0, "derived"), (25.0, "derived")]
    assert derived(spark, "balance_sheet", {"FY20": 500})["4Q20"] == (500.0, "copied_from_fy")
    assert derived(spark, "balance_sheet", {"FY20": 500, "4Q20": 9})["4Q20"] == (9.0, "kept")


def test_relabel(spark):
    rows = [("f", "s", p) for p in ("FY20", "3Q20", "4Q20", "1Q20", "4Q19")]
    shifted = st.fiscal_shift(spark.createDataFrame(rows, "file string, sheet string, period string"))
    assert {r.shifted for r in shifted.collect()} == {True}
    out = {r.period: r.new_period for r in st.relabel_shifted(shifted).collect()}
    assert out == {"FY20": "FY20", "3Q20": "3Q20", "4Q20": "4Q20", "1Q20": "2Q20", "4Q19": "1Q20"}


def test_sparse_columns(spark):
    rows = [("s", p, 1.0) for p, n in (("a", 20), ("b", 10), ("c", 9)) for _ in range(n)]
    out = st.drop_sparse_columns(spark.createDataFrame(rows, "sheet string, period string, value double"))
    assert {r.period for r in out.select("period").distinct().collect()} == {"a", "b"}


def test_net_interest(spark):
    schema = "k string, concept string, value double, pos long"
    f = spark.createDataFrame([("x", "us:InterestExpense", 100.0, 0), ("x", "us:InvestmentIncomeInterest", 25.0, 1), ("y", "us:InterestIncome", 7.0, 0), ("z", "us:InterestExpense", 1.0, 0), ("z", "us:NetInterest", 5.0, 1)], schema)
    assert {r.k: r.value for r in st.net_interest(f, ["k"]).collect()} == {"x": 75.0, "y": 7.0, "z": 5.0}


def test_sections_and_anchor(spark):
    rows = spark.createDataFrame([("s", 0, 10.0, False), ("s", 1, 5.0, False), ("s", 2, 15.0, True), ("s", 3, 4.0, False), ("s", 4, 5.0, True)], "k string, o int, value double, is_subtotal boolean")
    assert [(r.parts, r.passed) for r in st.check_sections(rows, ["k"], "o").orderBy("section").collect()] == [(15.0, True), (4.0, False)]
    lines = spark.createDataFrame([("s", 0, "a"), ("s", 1, None), ("s", 2, "b"), ("s", 3, None)], "k string, pos int, row_id string")
    assert [r.anchor for r in st.anchors(lines, ["k"], "pos").orderBy("pos").collect()] == [None, "a", "a", "b"]


def test_insert_keeps_order(spark):
    old = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "k string, row_id string, display_order int")
    new = spark.createDataFrame([("s", "x", "a", 0), ("s", "y", "a", 1), ("s", "z", None, 2), ("s", "w", "gone", 3)], "k string, row_id string, anchor string, seq int")
    assert [r.row_id for r in st.insert_after(old, new, ["k"]).orderBy("display_order").collect()] == ["z", "a", "x", "y", "b", "w"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], FACTS)
    assert compile_statements(none, files(spark)).count() == 0
    assert st.map_facts(none.withColumn("label", F.lit("")).drop("row_id"), spark.createDataFrame([], "stmt string, concept string, row_id string, pos long"), spark.createDataFrame([], "stmt string, row_id string, display_label string, display_order int")).count() == 0
