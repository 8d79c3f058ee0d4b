"""Filings, XBRL facts and debt documents."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import classes, keep, text as tx
from tallyframe.session import Scratch


def latest_filed(cells: DataFrame, keys: list[str], filed: str, frame: str, value: str) -> DataFrame:
    """The value last filed per key; on ties the greater frame."""
    return cells.groupBy(*keys).agg(F.max_by(value, F.struct(filed, frame, value)).alias(value), F.max(filed).alias(filed))


# fixed values: classes of concepts by which one of several reported values is chosen, the first that fits
VALUE_RULES = [
    (r"(?i)^(assets|liabilitiesandstockholdersequity|stockholdersequity)", "max_positive_or_abs"),
    (r"(?i)netincome|profitloss|beforeincometax|operatingincome", "middle"),
    (r"(?i)^(revenue|sales)", "max_positive_or_max"),
    (r"(?i)(other|non)operating.*income", "middle"),
    (r"(?i)expense|cost|charge|fee|payment|depreciation|amortization|impairment", "min_positive"),
]


def choose_value(values: Column, concept: Column) -> Column:
    """One of several distinct values of a fact, by the concept's class."""
    positive, negative = F.filter(values, lambda v: v > 0), F.filter(values, lambda v: v < 0)
    largest = F.element_at(F.array_sort(F.transform(values, lambda v: F.struct(F.abs(v).alias("a"), v.alias("v")))), -1)["v"]
    by = {
        "max_positive_or_abs": F.coalesce(F.array_max(positive), largest),
        "middle": keep.upper_median(values),
        "max_positive_or_max": F.coalesce(F.array_max(positive), F.array_max(values)),
        "min_positive": F.coalesce(F.array_min(positive), F.array_max(negative), F.array_max(values)),
    }
    out = None
    for pattern, rule in VALUE_RULES:
        out = F.when(concept.rlike(pattern), by[rule]) if out is None else out.when(concept.rlike(pattern), by[rule])
    return out.otherwise(largest)


def resolve_duplicates(facts: DataFrame, keys: list[str], concept: str, value: str, unit: str, dims: str) -> DataFrame:
    """One value per key: of the facts in USD if there are any, of those the ones with the fewest dimensions (unknown:
    99), of their distinct values the one of the concept's class."""
    rank = F.struct(F.when(F.upper(unit).contains("USD"), 0).otherwise(1).alias("u"), F.coalesce(dims, F.lit(99)).alias("d"))
    ranked = facts.where(F.col(value).isNotNull()).withColumn("__rank", rank)
    sets = ranked.groupBy(*keys, concept, "__rank").agg(F.collect_set(value).alias("values"))  # distinct values of one fact are few
    best = sets.groupBy(*keys, concept).agg(F.min_by("values", "__rank").alias("values"))
    return best.select(*keys, concept, choose_value(F.col("values"), F.col(concept)).alias(value), F.size("values").alias("n_values"))


#: Arcs that are sent to all tasks at most; more are joined by concept.
ARCS = 100_000


def rollups(arcs: DataFrame, values: DataFrame, keys: list[str], least: float = 2.5e6, share: float = 0.002) -> DataFrame:
    """Parents against the weighted sum of their children, where parent and every child have a value.
    arcs: parent, child, weight; values: keys, concept, value. Concepts are few and values many, so values aren't dealt
    out by concept: that would give all values of one to one task."""
    child = values.select(*keys, F.col("concept").alias("child"), F.col("value").alias("cv"))
    parent = values.select(*keys, F.col("concept").alias("parent"), F.col("value").alias("pv")).where("pv is not null")
    need = arcs.groupBy("parent").agg(F.count("*").alias("need"))
    if arcs.limit(ARCS + 1).count() <= ARCS:
        arcs, need = F.broadcast(arcs), F.broadcast(need)
    sums = arcs.join(child.where("cv is not null"), "child").groupBy(*keys, "parent").agg(F.sum(F.col("weight") * F.col("cv")).alias("total"), F.count("*").alias("have"))
    out = sums.join(need, "parent").where("have = need").join(parent, [*keys, "parent"])
    tolerance = F.greatest(F.lit(least), share * F.abs("pv"))
    return out.select(*keys, "parent", "pv", "total", (F.abs(F.col("pv") - F.col("total")) <= tolerance).alias("passed"))


def facts_by_context(facts: DataFrame, contexts: DataFrame, units: DataFrame) -> DataFrame:
    """facts with their context's period (facts without a context go), unit (may be missing) and number of dimensions."""
    return facts.join(contexts, "context_ref").join(units, "unit_ref", "left").withColumn("dim_count", F.coalesce("dim_count", F.lit(99)))


def amendment_chain(docs: DataFrame, key: str, at: str, is_amendment: str, tie: str) -> DataFrame:
    """Adds amendment_no (0 for originals) and base (the first original's tie value) per instrument. An instrument has
    few documents."""
    w = Window.partitionBy(key).orderBy(at, tie)
    whole = Window.partitionBy(key)
    n = F.sum(F.col(is_amendment).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    base = F.min(F.when(~F.col(is_amendment), F.struct(at, tie))).over(whole)[tie]
    return docs.withColumn("amendment_no", F.when(F.col(is_amendment), n).otherwise(0)).withColumn("base", base)


def heading_runs(headings: DataFrame, doc: str, pos: str, number: str) -> DataFrame:
    """Adds run: a new one starts when the number falls by 5 or more, or from 10 or more to 5 or less."""
    w = Window.partitionBy(doc).orderBy(pos)
    last = F.lag(number).over(w)
    restart = (last - F.col(number) >= 5) | ((last >= 10) & (F.col(number) <= 5))
    return headings.withColumn("__r", F.coalesce(restart.cast("int"), F.lit(0))).withColumn("run", F.sum("__r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__r")


def run_scores(runs: DataFrame, doc: str, pos: str, number: str) -> DataFrame:
    """Per run its length, the number of steps upwards and the upper median gap between its headings."""
    w = Window.partitionBy(doc, "run").orderBy(pos)
    steps = runs.withColumn("__gap", F.col(pos) - F.lag(pos).over(w)).withColumn("__up", (F.col(number) > F.lag(number).over(w)).cast("int"))
    out = steps.groupBy(doc, "run").agg(F.count("*").alias("n"), F.coalesce(F.sum("__up"), F.lit(0)).alias("n_up"), F.collect_list("__gap").alias("gaps"))
    return out.select(doc, "run", "n", "n_up", keep.upper_median(F.col("gaps")).alias("median_gap"))


def segments(headings: DataFrame, doc: str, start: str, end: str) -> DataFrame:
    """Adds segment_end: the next heading's start, or the text's end."""
    return headings.withColumn("segment_end", F.coalesce(F.lead(start).over(Window.partitionBy(doc).orderBy(start)), F.col(end)))


def carry_heading(lines: DataFrame, doc: str, pos: str, heading: str) -> DataFrame:
    """Fills heading (null on ordinary lines) from the last line that has one."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def reconcile_footnotes(notes: DataFrame, instruments: DataFrame) -> DataFrame:
    """The best instrument of all for each note: common words over the smaller set, and 0.25 and 0.2 more for the
    amount (the principal's first four digits, or fewer if it has fewer, in the note's) and the maturity (the due date's
    first four characters), at most 1; under 0.25 no match, under 0.45 weak. Of equals the first instrument.

    notes: note, description, amount, maturity; instruments: pos, name, principal, due. Pairs with a common word come
    from a join on words, of the distinct sets of words alone; the rest of the score is added to the few sets that can win. A pair without one scores 0.45, 0.25 or 0.2 by amount and maturity, so of all instruments
    with one amount, one maturity or one of both only the first can win: those firsts are joined to the parts of the
    notes' amounts and maturities. Where that first has common words too, the join on words gives its higher score."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(tx.match_title(F.coalesce(c, F.lit(""))), " "), lambda w: F.length(w) > 3)))
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    n = notes.select("note", words(F.col("description")).alias("nw"), digits(F.col("amount")).alias("na"), F.coalesce("maturity", F.lit("")).alias("nm"))
    i = instruments.select("pos", "name", words(F.col("name")).alias("iw"), F.substring(digits(F.col("principal")), 1, 4).alias("ia"), F.substring(F.coalesce("due", F.lit("")), 1, 4).alias("im"))
    # notes of one content have one answer, and of instruments of one content only the first can win: each content once
    asked = n.select("nw", "na", "nm").distinct()
    listed = i.groupBy("iw", "ia", "im").agg(F.min(F.struct("pos", "name")).alias("f"))
    nws, iws = asked.select("nw").distinct(), listed.select("iw").distinct()
    common = nws.select("nw", F.explode("nw").alias("w")).join(iws.select("iw", F.explode("iw").alias("w")), "w").groupBy("nw", "iw").agg(F.count("*").alias("common"))
    rated = common.select("nw", "iw", (F.col("common") / F.least(F.size("nw"), F.size("iw"))).alias("base"))
    # amount and maturity add 0.45 at most: sets further than that below the best one can't win
    best_base = rated.groupBy("nw").agg(F.max("base").alias("best"))
    near = rated.join(best_base, "nw").where(F.col("base") + 0.4500001 >= F.col("best")).select("nw", "iw", "base")
    score = F.col("base") + F.when((F.col("ia") != "") & F.col("na").contains(F.col("ia")), 0.25).otherwise(0.0) + F.when((F.col("im") != "") & F.col("nm").contains(F.col("im")), 0.2).otherwise(0.0)
    offers = near.join(listed, "iw").select("nw", "base", "ia", "im", "f").groupBy("nw", "base", "ia", "im").agg(F.min("f").alias("f"))
    won = asked.join(offers, "nw").withColumn("score", F.least(F.lit(1.0), score)).groupBy("nw", "na", "nm").agg(F.max_by(F.struct("f.pos", "f.name", "score"), F.struct("score", -F.col("f.pos"))).alias("b"))
    scored = n.join(won, ["nw", "na", "nm"]).select("note", "b.pos", "b.name", "b.score")
    # every part of one to four characters
    parts = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda at: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.substring(c, at, k)))))
    amounts, maturities = (n.select("note", "nm", F.explode(parts(F.col("na"))).alias("ia")), n.select("note", F.explode(parts(F.col("nm"))).alias("im")))
    both = amounts.select("note", "ia", F.explode(parts(F.col("nm"))).alias("im"))
    for wanted, on, points in ((both, ["ia", "im"], 0.45), (amounts, ["ia"], 0.25), (maturities, ["im"], 0.2)):
        first = i.where(" and ".join(f"{c} <> ''" for c in on)).groupBy(*on).agg(F.min(F.struct("pos", "name")).alias("f"))
        scored = scored.unionByName(wanted.join(first, on).select("note", "f.pos", "f.name", F.lit(points).cast("double").alias("score")))
    best = scored.groupBy("note").agg(F.max_by(F.struct("pos", "name", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    joined = n.select("note").join(best, "note", "left").select("note", "b.pos", "b.name", F.coalesce("b.score", F.lit(0.0)).alias("score"))
    status = F.when(F.col("score") < 0.25, "none").when(F.col("score") < 0.45, "weak").otherwise("match")
    ok = F.col("score") >= 0.25
    return joined.select("note", F.when(ok, F.col("pos")).alias("pos"), F.when(ok, F.col("name")).alias("name"), "score", status.alias("status"))


def annual_column(columns: DataFrame, keys: list[str]) -> DataFrame:
    """The column of each sheet that is most like a year by its days: 350 to 380, then 300 to 349, then 85 to 100;
    of equals the first. columns: keys, idx, days."""
    points = F.when(F.col("days").between(350, 380), 3).when(F.col("days").between(300, 349), 2).when(F.col("days").between(85, 100), 1).otherwise(0)
    return columns.groupBy(*keys).agg(F.max_by("idx", F.struct(points, -F.col("idx"))).alias("idx"))


def tree_rows(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of presentation trees with depth and sort path, children by order. arcs: role, parent, child, ord;
    roots: role, node. One join per level, until a level is empty; a node is shown once per depth, and not again below
    itself, so cycles end. Arcs and levels are written to the shared folder, so no level is worked out again for the
    next."""
    scratch = Scratch(arcs.sparkSession, "tree")
    level = scratch.write(roots.select("role", "node", F.lit(0).alias("depth"), F.array(F.struct(F.lit(0.0).alias("ord"), F.col("node").alias("node"))).alias("path")), "level0")
    found = [level]
    edges = scratch.write(arcs.select("role", F.col("parent").alias("node"), "child", F.col("ord").cast("double").alias("ord")), "arcs")
    for depth in itertools.count(1):
        step = level.join(edges, ["role", "node"]).where(~F.exists("path", lambda p: p["node"] == F.col("child"))).select("role", F.col("child").alias("node"), F.concat("path", F.array(F.struct("ord", F.col("child").alias("node")))).alias("path"))
        level = scratch.write(step.groupBy("role", "node").agg(F.min("path").alias("path")).select("role", "node", F.lit(depth).alias("depth"), "path"), f"level{depth}")
        if level.isEmpty():
            break
        found.append(level)
    scratch.drop("arcs", f"level{depth}")
    return reduce(DataFrame.unionByName, found)


def filter_forms(filings: DataFrame, forms: list[str], filed: str, as_of: str, years: int, least: int = 12, more: int = 7, most_years: int = 25) -> DataFrame:
    """Filings of the forms in the last years; looks further back once if there are fewer than least."""
    own = filings.where(F.col("form").isin(forms))
    back = lambda n: own.where(F.col(filed) >= F.add_months(F.to_date(F.lit(as_of)), -12 * n))
    first = back(years)
    return first if first.limit(least).count() >= least else back(min(most_years, years + more))


def columnar_rows(wide: DataFrame, arrays: list[str], key: str) -> DataFrame:
    """Rows from parallel arrays: key, pos and one column per array."""
    out = wide.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "r"))
    return out.select(key, "pos", *[f"r.{a}" for a in arrays])


# fixed values: patterns of amounts, rates and maturities in agreements
AMOUNT, RATE, MATURITY = r"\$\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s+(?:million|billion))?", r"[0-9]+(?:\.[0-9]+)?\s?%", r"(?i)due\s+((?:19|20)[0-9]{2})"


def instrument_terms(text: Column) -> Column:
    """Struct of the first amount, rate and maturity year in a text (null where there is none)."""
    first = lambda p, g: F.when(F.regexp_extract(text, p, g) != "", F.regexp_extract(text, p, g))
    return F.struct(first(AMOUNT, 0).alias("amount"), first(RATE, 0).alias("rate"), first(MATURITY, 1).alias("maturity"))


def period_scores(facts: DataFrame, keys: list[str], dims: str) -> DataFrame:
    """Score of each period: 3 for a fact without dimensions, 1 for another."""
    return facts.groupBy(*keys).agg(F.sum(F.when(F.col(dims) == 0, 3).otherwise(1)).alias("score"))


def latest_annual_report(filings_: DataFrame, owner: str, form: str, filed: str, tie: str) -> DataFrame:
    """The last annual report of each owner; amendments don't count."""
    return keep.keep_last(filings_.where(F.upper(F.trim(form)).isin("10-K", "20-F", "40-F", "10-KT")), [owner], [filed, tie])


def lookup_tickers(asked: DataFrame, directory: DataFrame, ticker: str) -> DataFrame:
    """asked with cik (ten digits): that of the first spelling in the directory (ticker, cik); digits of 6 to 10 places
    are a cik themselves; null where nothing fits."""
    tries = asked.select(ticker, F.posexplode(classes.ticker_spellings(F.col(ticker))).alias("nth", "t")).distinct()
    listed = keep.keep_first(directory.select(F.upper("ticker").alias("t"), F.col("cik").cast("string").alias("c")), ["t"], ["c"])
    hit = tries.join(listed, "t").groupBy(ticker).agg(F.min_by("c", "nth").alias("c"))
    own = F.when(F.trim(ticker).rlike(r"^\d{6,10}$"), F.trim(ticker))
    return asked.join(hit, ticker, "left").withColumn("cik", F.lpad(F.coalesce(own, "c"), 10, "0")).drop("c")


def viewer_concepts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, concept and label of the rows of a viewer page, in order, each concept once. A reference such as
    defref_us-gaap_Revenues names us-gaap:Revenues."""
    pattern = F.lit(r"(?is)Show\.showAR\(\s*this,\s*'defref_([^']+)'[^>]*>(.*?)</a>")
    names, labels = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(names.alias("n"), labels.alias("l"))).alias("pos", "r"))
    concept = F.regexp_replace(F.col("r.n"), "^([^_]+)_", "$1:")
    label = tx.html_to_text(F.col("r.l"))
    return keep.keep_first(rows.select(key, "pos", concept.alias("concept"), F.when(label == "", concept).otherwise(label).alias("label")), [key, "concept"], ["pos"])


def drop_stray_headings(headings: DataFrame, doc: str, pos: str, number: str) -> DataFrame:
    """Headings without those numbered 9 or more whose next one is 8 or less and more than 3 below: they are citations."""
    after = F.lead(number).over(Window.partitionBy(doc).orderBy(pos))
    return headings.withColumn("__next", after).where(~F.coalesce((F.col(number) >= 9) & (F.col("__next") <= 8) & (F.col("__next") < F.col(number) - 3), F.lit(False))).drop("__next")


# fixed values: concepts that structural checks compare, first ones first
CHECKED = {
    "assets": [r":Assets$"],
    "funding": [r"LiabilitiesAndStockholdersEquity$"],
    "net_income": [r":NetIncomeLoss$", r":ProfitLoss$", r"NetIncomeLossAvailableToCommonStockholdersBasic"],
    "pretax": [r"IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest$", r"IncomeLossFromContinuingOperationsBeforeIncomeTaxes$"],
    "tax": [r":IncomeTaxExpenseBenefit$"],
    "operating": [r"NetCashProvidedByUsedInOperatingActivities"],
    "investing": [r"NetCashProvidedByUsedInInvestingActivities"],
    "financing": [r"NetCashProvidedByUsedInFinancingActivities"],
    "cash_change": [r"CashCashEquivalentsPeriodIncreaseDecrease$", r"CashCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect$", r"CashAndCashEquivalentsPeriodIncreaseDecrease"],
}


def structural_checks(facts: DataFrame, keys: list[str], tolerance: float, cash_tolerance: float) -> DataFrame:
    """keys, name, gap and passed of three checks, where all their values are there: assets = liabilities and equity;
    pretax income plus or minus tax = net income; the three cash flows = change of cash. facts: keys, pos (a whole number
    of less than 2^49), concept, value."""
    picks = []
    for name, patterns in CHECKED.items():
        rank = F.lit(None).cast("int")
        for i, p in reversed(list(enumerate(patterns))):
            rank = F.when(F.col("concept").rlike(f"(?i){p}"), i).otherwise(rank)
        picks.append(F.min_by(F.when(rank.isNotNull(), F.col("value")), F.when(rank.isNotNull(), rank.cast("long") * (1 << 50) + F.col("pos").cast("long"))).alias(name))  # numbers, so that rows are hashed, not sorted
    v = facts.where("value is not null").groupBy(*keys).agg(*picks)
    c = F.col
    income = F.least(F.abs(c("pretax") + c("tax") - c("net_income")), F.abs(c("pretax") - c("tax") - c("net_income")))
    cash = F.abs(c("operating") + c("investing") + c("financing") - c("cash_change"))
    checks = [("assets", F.abs(c("assets") - c("funding")), tolerance), ("net_income", F.when((c("pretax") + c("tax") + c("net_income")).isNotNull(), income), tolerance), ("cash", cash, cash_tolerance)]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), gap.alias("gap"), (gap <= most).alias("passed")) for n, gap, most in checks])
    return v.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").where("gap is not null")


def flatten_workbook(rows: DataFrame) -> DataFrame:
    """Facts from rows with a map of values by period: kind, concept, line, period, value and filename. Rows without a
    concept, and values that are missing or no numbers, go."""
    each = rows.where(F.coalesce("concept", F.lit("")) != "").select("filename", "kind", "concept", "line", F.explode("values_by_period").alias("period", "value"))
    return each.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
