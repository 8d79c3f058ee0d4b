"""The whole compile on small workbooks whose answers are worked out by hand."""

import pytest

from tallyframe.plans.compile import compile_workbooks

CELLS = "stmt string, file string, sheet string, pos long, concept string, label string, period string, value double"
LINES = "stmt string, file string, pos long, concept string, label string, depth int"
FILES = "file string, latest_fy int, is_10k boolean"
IS, BS, CF = "income_statement", "balance_sheet", "cash_flow"


def book(file, stmt, rows, periods):
    """Cells and lines of one sheet. rows: concept, label, values by period (None: no value)."""
    cells = [(stmt, file, stmt, i, c, label, p, float(v)) for i, (c, label, values) in enumerate(rows) for p, v in zip(periods, values) if v is not None]
    return cells, [(stmt, file, i, c, label, 0) for i, (c, label, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def compiled(spark):
    parts = [
        book("10k_new", IS, [("us:Revenue", "Revenue", [100]), ("us:InterestExpenseNet", "Interest expense, net", [8]), ("us:NetIncome", "Net income", [40])], ["FY21"]),
        book("10k_new", BS, [("us:Assets", "Total assets", [500]), ("us:Goodwill", "Goodwill", [None])], ["FY21"]),
        book("10k_new", CF, [("us:Cfo", "Cash from operations", [90])], ["FY21"]),
        # the name alone, the label alone, a line between, legs of interest; a column that is nearly empty
        book("10q_1", IS, [("acme:Revenue", "Sales", [20, 21, None]), ("acme:Fees", "Fees", [3, 3, 1]), ("x:InterestExpenseDebt", "Interest", [5, 5, None]), ("x:InvestmentIncomeInterest", "Interest income", [2, 1, None]), ("acme:Profit", "Net incomes", [9, 9, None]), (" ", "blank", [7, None, None])], ["1Q21", "2Q21", "3Q21"]),
        book("10q_1", CF, [("us:Cfo", "Cash from operations", [10, 30])], ["1Q21", "6M21"]),
        book("10q_2", IS, [("us:Revenue", "Revenue", [19, 25]), ("us:NetIncome", "Net income", [None, 11])], ["1Q21", "3Q21"]),
        book("10q_2", CF, [("us:Cfo", "Cash from operations", [45])], ["9M21"]),
    ]
    cells = spark.createDataFrame([c for p in parts for c in p[0]], CELLS)
    lines = spark.createDataFrame([x for p in parts for x in p[1]], LINES)
    files = spark.createDataFrame([("10k_new", 2021, True), ("10q_1", 2020, False), ("10q_2", 2021, False)], FILES)
    return compile_workbooks(cells, lines, files)


def test_rows_and_map(compiled):
    rows = {(r.stmt, r.row_id): r for r in compiled.rows.collect()}
    order = sorted((r.display_order, r.row_id) for r in rows.values() if r.stmt == IS)
    # legs of interest keep their lines, though their values go to the net line
    assert [x for _, x in order] == ["us:Revenue", "acme:Fees", "x:InterestExpenseDebt", "x:InvestmentIncomeInterest", "us:InterestExpenseNet", "us:NetIncome"]
    assert rows[IS, "acme:Fees"].display_label == "Fees" and (BS, "us:Goodwill") in rows
    got = {(r.stmt, r.concept): (r.row_id, r.status) for r in compiled.concept_map.collect()}
    assert got[IS, "acme:Revenue"] == ("us:Revenue", "auto_local_name") and got[IS, "acme:Profit"] == ("us:NetIncome", "auto_label_match")
    assert got[IS, "x:InterestExpenseDebt"] == ("us:InterestExpenseNet", "interest_net_alias") == got[IS, "x:InvestmentIncomeInterest"]
    assert got[IS, "acme:Fees"] == ("acme:Fees", "auto_from_filing") and got[IS, "us:Revenue"][1] == "auto_from_master"


def test_cells(compiled):
    got = {(r.row_id, r.period): (r.value, r.how) for r in compiled.cells.collect()}
    # the newer quarterly report wins the first quarter; the third quarter's nearly empty column of the older one is gone
    assert got["us:Revenue", "1Q21"][0] == 19 and got["us:Revenue", "2Q21"][0] == 21 and got["us:Revenue", "3Q21"][0] == 25
    assert got["us:Revenue", "4Q21"] == (100 - 19 - 21 - 25, "derived")
    assert got["us:InterestExpenseNet", "1Q21"][0] == 3 and got["us:InterestExpenseNet", "2Q21"][0] == 4 and got["us:InterestExpenseNet", "4Q21"] == (8 - 3 - 4, "derived")
    assert got["us:NetIncome", "1Q21"][0] == 9 and got["us:NetIncome", "4Q21"] == (40 - 9 - 9 - 11, "derived")
    assert got["acme:Fees", "1Q21"][0] == 3 and ("acme:Fees", "3Q21") not in got and ("acme:Fees", "4Q21") not in got
    assert got["us:Assets", "4Q21"] == (500, "copied_from_fy") and got["us:Assets", "FY21"][0] == 500
    assert [got["us:Cfo", p][0] for p in ("1Q21", "2Q21", "3Q21", "4Q21", "6M21", "9M21", "FY21")] == [10, 20, 15, 45, 30, 45, 90]


def test_conflicts_unresolved_and_checks(compiled):
    assert [(r.row_id, r.period, [tuple(v) for v in r["values"]]) for r in compiled.conflicts.collect()] == [("us:Revenue", "1Q21", [("10q_2", 19.0), ("10q_1", 20.0)])]
    assert [(r.concept, r.value) for r in compiled.unresolved.collect()] == [(" ", 7.0)]
    assert {(r.row_id, r.passed) for r in compiled.checks.collect()} == {("us:Revenue", True), ("us:NetIncome", True), ("us:Cfo", True)}


def test_outside_mapping_and_empty_input(spark):
    cells, lines = book("a", IS, [("us:Sales", "Sales", [1])], ["1Q21"])
    more, extra = book("b", IS, [("z:Turnover", "Umsatz", [2]), ("z:Other", "Anderes", [3])], ["2Q21"])
    files = spark.createDataFrame([("a", 2021, True), ("b", 2020, False)], FILES)
    told = spark.createDataFrame([(IS, "z:Turnover", "us:Sales"), (IS, "z:Other", "no:Row")], "stmt string, concept string, row_id string")
    out = compile_workbooks(spark.createDataFrame(cells + more, CELLS), spark.createDataFrame(lines + extra, LINES), files, told)
    assert {(r.row_id, r.period): r.value for r in out.cells.collect()} == {("us:Sales", "1Q21"): 1, ("us:Sales", "2Q21"): 2, ("z:Other", "2Q21"): 3}
    none = compile_workbooks(spark.createDataFrame([], CELLS), spark.createDataFrame([], LINES), spark.createDataFrame([], FILES))
    assert none.cells.count() == none.rows.count() == none.checks.count() == 0
