"""Statement compiler: map facts to rows, consolidate them over sources, derive periods, fill gaps, validate.

facts: stmt, concept, label, period, file, pos, value. Positions make "the first" and "the last" mean something.
Every step is a DataFrame operator; per-key work is a partial aggregate, so no key's rows meet in one task unreduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import periods, text
from tallyframe.functions.keep import keep_first, keep_last

TOLERANCE = 0.5
BUCKET = ["stmt", "row_id", "period", "file"]
CELL = ["stmt", "row_id", "period"]


def drop_sparse_columns(cells: DataFrame, sheet: str = "sheet", column: str = "period", value: str = "value", share: float = 0.5) -> DataFrame:
    """Cells of the columns that have at least so large a share of the fullest column's values. Columns at the cutoff
    stay; in a sheet without values all stay."""
    counts = cells.groupBy(sheet, column).agg(F.count(value).alias("__n"))
    most = counts.groupBy(sheet).agg(F.max("__n").alias("__most"))
    kept = counts.join(most, sheet).where(F.col("__n") >= share * F.col("__most")).select(sheet, column)
    return cells.join(kept, [sheet, column], "left_semi")


def recency(workbooks: DataFrame) -> DataFrame:
    """Adds recency, 0 for the oldest, by (latest_fy, filename). One row per workbook, so the ranking is small."""
    return workbooks.withColumn("recency", F.row_number().over(Window.orderBy("latest_fy", "filename")) - 1)


def pick_master(workbooks: DataFrame) -> DataFrame:
    """The workbook of the latest year, among annual reports if there are any; of several the first name."""
    return workbooks.orderBy(F.desc("is_10k"), F.desc("latest_fy"), "filename").limit(1)


def map_facts(facts: DataFrame, concept_map: DataFrame, rows: DataFrame) -> DataFrame:
    """facts with row_id, display_label (the row's, else the fact's) and reason: null where mapped, else blank_concept
    or no_mapping. Of several map entries (stmt, concept, row_id, pos) of a concept the last holds."""
    entries = keep_last(concept_map.select("stmt", "concept", "row_id", "pos"), ["stmt", "concept"], ["pos", "row_id"]).drop("pos")
    names = keep_first(rows.select("stmt", "row_id", "display_label", "display_order"), ["stmt", "row_id"], ["display_order", "display_label"]).drop("display_order")
    out = facts.join(entries, ["stmt", "concept"], "left").join(names, ["stmt", "row_id"], "left")
    blank = F.trim(F.coalesce("concept", F.lit(""))) == ""
    reason = F.when(blank, "blank_concept").when(F.col("row_id").isNull(), "no_mapping")
    return out.withColumn("display_label", F.coalesce("display_label", "label")).withColumn("reason", reason)


def match_concepts(unmapped: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for concepts by local name, else by normal label (not on balance sheets); the first row by display_order
    wins. unmapped: stmt, concept, label. Adds row_id and method (local_name, label or null)."""
    by_name = keep_first(rows.select("stmt", text.local_name(F.col("concept")).alias("name"), "row_id", "display_order"), ["stmt", "name"], ["display_order", "row_id"])
    by_label = keep_first(rows.where("stmt <> 'balance_sheet'").select("stmt", text.statement_label(F.col("display_label")).alias("norm"), "row_id", "display_order"), ["stmt", "norm"], ["display_order", "row_id"])
    out = unmapped.withColumn("name", text.local_name(F.col("concept"))).withColumn("norm", text.statement_label(F.col("label")))
    out = out.join(by_name.select("stmt", "name", F.col("row_id").alias("r1")), ["stmt", "name"], "left").join(by_label.select("stmt", "norm", F.col("row_id").alias("r2")), ["stmt", "norm"], "left")
    method = F.when(F.col("r1").isNotNull(), "local_name").when(F.col("r2").isNotNull(), "label")
    return out.select(*unmapped.columns, F.coalesce("r1", "r2").alias("row_id"), method.alias("method"))


def accept_external(mapping: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of a mapping made elsewhere whose row exists."""
    return mapping.join(rows.select("stmt", "row_id").distinct(), ["stmt", "row_id"], "left_semi")


def anchors(sheet_rows: DataFrame, keys: list[str], pos: str, row_id: str = "row_id") -> DataFrame:
    """Adds anchor: the row of the nearest earlier line of the sheet that has one."""
    before = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return sheet_rows.withColumn("anchor", F.last(row_id, ignorenulls=True).over(before))


def insert_after(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with new ones placed right after their anchors, in the order of seq, and numbered anew from 0.

    existing: keys, row_id, display_order; new: keys, row_id, anchor, seq. Without an anchor: before all; with an
    unknown one: after all."""
    order = existing.select(*keys, F.col("row_id").alias("anchor"), F.col("display_order").alias("__at"))
    placed = new.join(order, [*keys, "anchor"], "left").withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "anchor").orderBy("seq")))
    at = F.when(F.col("anchor").isNull(), -1 + 0.001 * F.col("__nth")).when(F.col("__at").isNull(), 9999 + F.col("seq")).otherwise(F.col("__at") + 0.001 * F.col("__nth"))
    both = existing.select(*keys, "row_id", F.col("display_order").cast("double").alias("__at")).unionByName(placed.select(*keys, "row_id", at.alias("__at")))
    return both.select(*keys, "row_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("__at", "row_id")) - 1).alias("display_order"))


def bucket_values(mapped: DataFrame, masters: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One value per (stmt, row_id, period, file), by the first rule that applies:

    one concept: the first value by pos (ties: the least). Several: the value of the row's master concept; else the first value that the
    others sum to (a subtotal, within tolerance); else the sum. masters: stmt, row_id, master_concept.
    Nulls don't count as values but their concepts do. Returns value, n_concepts and method."""
    grouped = mapped.groupBy(*BUCKET).agg(F.collect_list(F.struct("pos", "value", "concept")).alias("all"))  # a cell has few facts
    if masters is not None:
        grouped = grouped.join(masters, ["stmt", "row_id"], "left")
    else:
        grouped = grouped.withColumn("master_concept", F.lit(None).cast("string"))
    concepts = F.array_distinct(F.filter(F.transform("all", lambda x: x["concept"]), lambda c: c.isNotNull()))
    g = grouped.select(*BUCKET, "master_concept", F.size(concepts).cast("long").alias("n_concepts"), F.sort_array(F.filter("all", lambda x: x["value"].isNotNull())).alias("vals")).where(F.size("vals") > 0)
    g = g.withColumn("total", F.aggregate("vals", F.lit(0.0), lambda a, x: a + x["value"].cast("double")))
    first = lambda condition: F.get(F.filter("vals", condition), F.lit(0))["value"]
    master = first(lambda x: x["concept"] == F.col("master_concept"))
    subtotal = first(lambda x: (F.size("vals") > 1) & (F.abs(2 * x["value"] - F.col("total")) <= tolerance))
    single = F.col("n_concepts") == 1
    value = F.when(single, F.get("vals", F.lit(0))["value"]).otherwise(F.coalesce(master, subtotal, F.col("total")))
    method = F.when(single | F.coalesce(master, subtotal).isNotNull(), "reported").otherwise("summed_within_file")
    return g.select(*BUCKET, value.alias("value"), "n_concepts", method.alias("method"))


def newest_value(buckets: DataFrame, files: DataFrame) -> DataFrame:
    """One value per (stmt, row_id, period): that of the newest file, null or not. files: file, recency. Adds the
    file, n_values (distinct values over files) and is_conflict."""
    ranked = buckets.join(files.select("file", "recency"), "file")
    best = F.max_by(F.struct("value", "file", "method"), F.struct("recency", "file"))
    out = ranked.groupBy(*CELL).agg(best.alias("b"), F.countDistinct("value").alias("n_values"))
    return out.select(*CELL, "b.value", "b.file", "b.method", "n_values", (F.col("n_values") > 1).alias("is_conflict"))


def conflicts(buckets: DataFrame, files: DataFrame) -> DataFrame:
    """The cells with several distinct values, with all of them, newest file first."""
    ranked = buckets.where("value is not null").join(files.select("file", "recency"), "file")
    entry = F.struct((-F.col("recency")).alias("age"), "file", "value")
    out = ranked.groupBy(*CELL).agg(F.countDistinct("value").alias("n"), F.sort_array(F.collect_list(entry)).alias("all"))
    return out.where("n > 1").select(*CELL, F.transform("all", lambda x: F.struct(x["file"].alias("file"), x["value"].alias("value"))).alias("values"))


# fixed values: name patterns of interest concepts
NET_INTEREST = r"(?i)InterestIncomeExpenseNet|InterestExpenseNet|NetInterest|InterestAndDebtExpense"
INTEREST_INCOME = r"(?i)InterestIncome|InvestmentIncomeInterest|DividendIncomeInterest"
INTEREST_EXPENSE = r"(?i)InterestExpense|InterestCosts|AmortizationOfFinancingCosts|DebtRelatedCommitmentFees"


def interest_leg(concept: Column) -> Column:
    name = text.local_name(concept)
    return F.when(name.rlike(NET_INTEREST), "net").when(name.rlike(INTEREST_INCOME), "income").when(name.rlike(INTEREST_EXPENSE), "expense")


def net_interest(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Net interest per key: the combined tag's value if there is one, a single value as it is, else expense less income."""
    leg = interest_leg(F.col("concept"))
    rows = mapped.where(F.col("value").isNotNull() & leg.isNotNull()).withColumn("leg", leg)
    part = lambda name: F.sum(F.when(F.col("leg") == name, F.col("value")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("only"), F.min_by(F.when(F.col("leg") == "net", F.col("value")), F.when(F.col("leg") == "net", F.struct("pos", "value"))).alias("net"), part("expense").alias("expense"), part("income").alias("income"))
    zero = F.lit(0.0)
    value = F.coalesce("net", F.when(F.col("n") == 1, F.col("only")), F.coalesce("expense", zero) - F.coalesce("income", zero))
    return out.select(*keys, value.alias("value"), F.when(F.col("net").isNull() & (F.col("n") > 1), "interest_net").otherwise("reported").alias("method"))


def _wide(cells: DataFrame) -> DataFrame:
    """One row per (stmt, row_id, year), one column per period type; reported_<type> says whether it was read as such."""
    kind, year = periods.period_type(F.col("period")), periods.fiscal_year(F.col("period"))
    long = cells.withColumn("kind", kind).withColumn("year", year).where("kind is not null")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    read = lambda k: F.max((F.col("kind") == k) & (F.col("method") == "reported")).alias(f"reported_{k}")
    return long.groupBy("stmt", "row_id", "year").agg(*[f(k) for k in periods.TYPE_ORDER for f in (pick, read)])


def derive(cells: DataFrame) -> DataFrame:
    """Adds derived periods. cells: stmt, row_id, period, value, method; methods of new cells: derived, copied_from_fy.

    Income statement: 4Q = FY - 1Q - 2Q - 3Q (missing quarters count 0) whenever FY is there, over any reported 4Q.
    Balance sheet: 4Q = FY where 4Q is missing. Cash flow: 2Q = 6M - 1Q, 3Q = 9M - 6M, 4Q = FY - 9M where the target
    is missing and wasn't reported and the longer span is there (a missing shorter one counts 0)."""
    w = _wide(cells)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    income, balance, cash = (F.col("stmt") == s for s in ("income_statement", "balance_sheet", "cash_flow"))
    q4_income = F.when(F.col("FY").isNotNull(), F.col("FY") - zero("Q1") - zero("Q2") - zero("Q3"))
    later = lambda target, long, short: F.when(F.col(target).isNull() & ~F.coalesce(F.col(f"reported_{target}"), F.lit(False)) & F.col(long).isNotNull(), F.col(long) - zero(short))
    q2, q3, q4_cash = later("Q2", "6M", "Q1"), later("Q3", "9M", "6M"), later("Q4", "FY", "9M")
    new = {
        "Q2": F.when(cash, q2),
        "Q3": F.when(cash, q3),
        "Q4": F.when(income, q4_income).when(balance & F.col("Q4").isNull(), F.col("FY")).when(cash, q4_cash),
    }
    w = w.withColumns({f"new_{k}": v for k, v in new.items()})
    entries = []
    for k in periods.TYPE_ORDER:
        fresh = F.col(f"new_{k}") if k in new else F.lit(None).cast("double")
        how = F.when(fresh.isNull(), F.lit("kept")).when(balance, "copied_from_fy").otherwise("derived")
        entries.append(F.struct(periods.canonical(F.lit(k), F.col("year")).alias("period"), F.coalesce(fresh, F.col(k)).alias("value"), how.alias("how")))
    out = w.select("stmt", "row_id", "year", F.explode(F.array(*entries)).alias("e")).where("e.value is not null")
    return out.select("stmt", "row_id", "year", "e.period", "e.value", "e.how")


def fill_gaps(cells: DataFrame, buckets: DataFrame, files: DataFrame) -> DataFrame:
    """cells with nulls and missing cells filled by the newest value there is; filled says which."""
    ranked = buckets.where("value is not null").join(files.select("file", "recency"), "file")
    newest = ranked.groupBy(*CELL).agg(F.max_by("value", F.struct("recency", "file")).alias("newest"))
    out = cells.select(*CELL, "value").join(newest, CELL, "full")
    return out.select(*CELL, F.coalesce("value", "newest").alias("value"), F.col("value").isNull().alias("filled"))


def register_missing(raw: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Raw items (with keys) that no known row covers, once each."""
    return raw.select(*keys).distinct().join(known.select(*keys).distinct(), keys, "left_anti")


def prune_mapped(unresolved: DataFrame, concept_map: DataFrame) -> DataFrame:
    return unresolved.join(concept_map.select("stmt", "concept").distinct(), ["stmt", "concept"], "left_anti")


def check_quarter_sum(cells: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row and year with all five cells: whether the quarters sum to the year."""
    w = _wide(cells).where("Q1 is not null and Q2 is not null and Q3 is not null and Q4 is not null and FY is not null and stmt <> 'balance_sheet'")
    gap = F.col("Q1") + F.col("Q2") + F.col("Q3") + F.col("Q4") - F.col("FY")
    return w.select("stmt", "row_id", "year", gap.alias("gap"), (F.abs(gap) <= tolerance).alias("passed"))


def check_equation(cells: DataFrame, keys: list[str], role: str, left: str, right: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Per key with every role: whether the left role's value is the sum of the right ones'."""
    pick = lambda r: F.max(F.when(F.col(role) == r, F.col("value"))).alias(r)
    w = cells.groupBy(*keys).agg(*[pick(r) for r in (left, *right)]).dropna()
    gap = F.col(left) - sum((F.col(r) for r in right[1:]), F.col(right[0]))
    return w.select(*keys, gap.alias("gap"), (F.abs(gap) <= tolerance).alias("passed"))


def check_sections(rows: DataFrame, keys: list[str], order: str, tolerance: float = TOLERANCE) -> DataFrame:
    """For every subtotal row, whether it is the sum of the rows since the subtotal before. rows: keys, order, value,
    is_subtotal. Keys name one statement and period, whose rows are few."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    section = F.coalesce(F.sum(F.col("is_subtotal").cast("int")).over(before), F.lit(0))
    out = rows.withColumn("section", section).groupBy(*keys, "section").agg(F.sum(F.when(~F.col("is_subtotal"), F.coalesce("value", F.lit(0.0)))).alias("parts"), F.max(F.when(F.col("is_subtotal"), F.col("value"))).alias("subtotal"))
    out = out.where("subtotal is not null")
    return out.select(*keys, "section", F.coalesce("parts", F.lit(0.0)).alias("parts"), "subtotal", (F.abs(F.coalesce("parts", F.lit(0.0)) - F.col("subtotal")) <= tolerance).alias("passed"))


def fiscal_shift(facts: DataFrame) -> DataFrame:
    """Adds shifted: whether a sheet's labels run a quarter late. In such a sheet some year has 3Q and 4Q but no 2Q
    while it has 1Q and the year before has 4Q."""
    kind, year = periods.period_type(F.col("period")), periods.fiscal_year(F.col("period"))
    has = lambda k: F.max(F.col("kind") == k).alias(k)
    years = facts.withColumn("kind", kind).withColumn("year", year).where("kind is not null").groupBy("file", "sheet", "year").agg(*[has(k) for k in ("Q1", "Q2", "Q3", "Q4")])
    last = years.select("file", "sheet", (F.col("year") + 1).alias("year"), F.col("Q4").alias("last_q4"))
    odd = years.join(last, ["file", "sheet", "year"]).where("Q1 and Q3 and Q4 and not Q2 and last_q4")
    late = odd.select("file", "sheet").distinct().withColumn("shifted", F.lit(True))
    return facts.join(late, ["file", "sheet"], "left").withColumn("shifted", F.coalesce("shifted", F.lit(False)))


def relabel_shifted(facts: DataFrame) -> DataFrame:
    """Renames quarters of shifted sheets: 1Q becomes 2Q; 4Q becomes 1Q of the next year unless the sheet has that
    year's FY or 3Q, and only if there is a FY within a year of the next. Adds new_period."""
    kind, year = periods.period_type(F.col("period")), periods.fiscal_year(F.col("period"))
    f = facts.withColumn("kind", kind).withColumn("year", year)
    sheets = f.groupBy("file", "sheet").agg(F.collect_set(F.when(F.col("kind") == "FY", F.col("year"))).alias("fy"), F.collect_set(F.when(F.col("kind") == "Q3", F.col("year"))).alias("q3"))
    near = F.exists("fy", lambda y: F.abs(y - (F.col("year") + 1)) <= 1)
    moved = F.when(F.col("kind") == "Q1", periods.canonical(F.lit("Q2"), F.col("year"))).when(
        (F.col("kind") == "Q4") & ~F.array_contains("fy", F.col("year")) & ~F.array_contains("q3", F.col("year")) & near, periods.canonical(F.lit("Q1"), F.col("year") + 1)
    )
    out = f.join(sheets, ["file", "sheet"]).withColumn("new_period", F.when(F.col("shifted"), F.coalesce(moved, "period")).otherwise(F.col("period")))
    return out.select(*facts.columns, "new_period")


def display_from(cells: DataFrame, floor: int) -> DataFrame:
    """Cells of the years from the first that has all four quarters, but not before floor; floor alone if there is none."""
    years = cells.withColumn("kind", periods.period_type(F.col("period"))).withColumn("year", periods.fiscal_year(F.col("period"))).where("kind like 'Q%'")
    full = years.groupBy("year").agg(F.countDistinct("kind").alias("n")).where("n = 4").agg(F.greatest(F.lit(floor), F.coalesce(F.min("year"), F.lit(floor))).alias("__from"))
    return cells.join(F.broadcast(full), periods.fiscal_year(F.col("period")) >= F.col("__from")).drop("__from")  # one row


def statement_table(cells: DataFrame, labels: list[str]) -> DataFrame:
    """One row per stmt and row_id, one column per period label, in the order given."""
    return cells.groupBy("stmt", "row_id").pivot("period", labels).agg(F.first("value"))


def reconcile_final(cells: DataFrame, facts: DataFrame, concept_map: DataFrame, files: DataFrame) -> DataFrame:
    """Fills empty cells from raw facts: of a cell's concepts the alphabetically first that has a value, and of its facts
    the newest file's. facts: stmt, concept, period, file, value; concept_map: stmt, concept, row_id."""
    valued = facts.where("value is not null").join(files.select("file", "recency"), "file").join(concept_map.select("stmt", "concept", "row_id"), ["stmt", "concept"])
    newest = valued.groupBy(*CELL).agg(F.max_by("value", F.struct(_descending(F.col("concept")), "recency", "file")).alias("found"))
    out = cells.select(*CELL, "value").join(newest, CELL, "full")
    return out.select(*CELL, F.coalesce("value", "found").alias("value"), (F.col("value").isNull() & F.col("found").isNotNull()).alias("filled"))


def _descending(name: Column) -> Column:
    """A key that orders names of ASCII characters the other way round: the least name has the greatest key."""
    return F.concat(F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: -F.ascii(c)), F.array(F.lit(0)))


def number_repeats(rows: DataFrame, keys: list[str], label: str, pos: str, suffix: str) -> DataFrame:
    """Labels that repeat within keys get ' · ' and the suffix column's value from the second on."""
    nth = F.row_number().over(Window.partitionBy(*keys, label).orderBy(pos))
    return rows.withColumn("__n", nth).withColumn(label, F.when(F.col("__n") > 1, F.concat_ws(" · ", label, suffix)).otherwise(F.col(label))).drop("__n")


def drop_short_columns(columns: DataFrame, sheet: str, days: str, least: int = 28, enough: int = 3) -> DataFrame:
    """Columns of at least so many days, in sheets that have enough of those; other sheets keep all."""
    long = columns.groupBy(sheet).agg(F.count_if(F.col(days) >= least).alias("__long"))
    return columns.join(long, sheet).where((F.col("__long") < enough) | (F.col(days) >= least)).drop("__long")
