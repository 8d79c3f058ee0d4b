"""Printed statements in Markdown against the facts that they were made from: what differs, and the text put right.

Lines and cells of a text are rows; a printed cell meets its facts by document, statement, concept and period, where a
period is a set of names that both sides can have in common (the words themselves, its last day, its fiscal year), so
periods written in unlike ways meet by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that differ by no more are equal.
TOLERANCE = 0.02
_DAY = r"\d{4}-\d{2}-\d{2}"
_RANGE = rf"(?i)({_DAY})\s*(?:to|→|->)\s*({_DAY})"
_YEAR = r"\bfy\s*'?(\d{2}|\d{4})(?:\s*e)?\b"
_QUARTER = r"\b(?:q([1-4])|([1-4])q)\s*'?(\d{2}|\d{4})\b"


def _strip(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\*\*", ""))


def label(c: Column) -> Column:
    """A line's name as it is compared: lower case, without stars and punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\*\*", "")), "[.,;:]", " "), r"\s+", " "))


def _full_year(c: Column) -> Column:
    n = c.cast("int")
    return F.when(n < 100, n + 2000).otherwise(n)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def fact_period_names(period: Column) -> Column:
    """Names of a fact's period ("2017-01-01 to 2017-12-31", "2017-12-31", others as they stand): its words, its last
    day, and its fiscal year if it spans 330 days or more, or is the last day of a year. Null and empty: none."""
    p = F.trim(F.coalesce(period, F.lit("")))
    start, end = _found(p, _RANGE, 1), F.coalesce(_found(p, _RANGE, 2), _found(p, rf"^({_DAY})$", 1))
    days = F.datediff(_found(p, _RANGE, 2).try_cast("date"), start.try_cast("date"))
    annual = (days >= 330) | (days.isNull() & end.endswith("-12-31"))
    names = F.array(F.when(p != "", F.concat(F.lit("="), F.lower(p))), F.concat(F.lit("end "), end), F.when(annual, F.concat(F.lit("year "), F.substring(end, 1, 4).cast("int").cast("string"))))
    return F.array_compact(names)


def header_period_names(header: Column) -> Column:
    """Names of the period that a column's header tells: its words, every day in it, FY2017 or FY17, and the last day of
    Q3 2017, 3Q17 and the like."""
    h = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    days = F.transform(F.regexp_extract_all(h, F.lit(rf"(?=({_DAY}))"), F.lit(1)), lambda d: F.concat(F.lit("end "), d))
    quarter = F.coalesce(_found(h, _QUARTER, 1), _found(h, _QUARTER, 2)).cast("int")
    last = F.element_at(F.array(*map(F.lit, ["-03-31", "-06-30", "-09-30", "-12-31"])), quarter)
    names = F.array(F.when(h != "", F.concat(F.lit("="), h)), F.concat(F.lit("year "), _full_year(_found(h, _YEAR, 1)).cast("string")), F.concat(F.lit("end "), F.lpad(_full_year(_found(h, _QUARTER, 3)).cast("string"), 4, "0"), last))
    return F.array_distinct(F.concat(F.array_compact(names), days))


def statement_of_title(title: Column) -> Column:
    """cf, bs or is by the words of a heading; null for others."""
    t = F.lower(F.coalesce(title, F.lit("")))
    any_ = lambda *words: F.greatest(*[t.contains(w) for w in words]) if len(words) > 1 else t.contains(words[0])
    return F.when(any_("cash flow", "cashflow"), "cf").when(any_("balance", "financial position"), "bs").when(any_("income", "operations", "earnings", "p&l", "profit and loss"), "is")


def printed_number(cell: Column) -> Column:
    """The number that a printed cell tells: (1,234) is negative, 1.5m and 2b are scaled, a percent sign divides; dashes,
    n/a and words are null."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(s, "[$€£¥]", ""), r"\s", "")
    negative = bare.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.when(negative, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), ",", "")
    scale = F.when(bare.rlike(r"(?i)[\d.].*m$"), 1e6).when(bare.rlike(r"(?i)[\d.].*b$"), 1e9).otherwise(1.0)
    number = _found(F.when(scale != 1.0, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    value = number * F.when(negative, -1.0).otherwise(1.0) * scale / F.when(bare.endswith("%"), 100.0).otherwise(1.0)
    return F.when(~s.rlike(r"(?i)^[–—-]+$|^n/?a$|^nm$|^$"), value)


def printed_money(value: Column) -> Column:
    """Two decimals and thousands marks; negative values in brackets."""
    told = F.format_number(F.round(F.abs(value), 2), 2)
    return F.when(value < 0, F.concat(F.lit("("), told, F.lit(")"))).otherwise(told)


def _lines(docs: DataFrame) -> DataFrame:
    """key, line, s, kind (of the last heading above) and block (number of the table; null outside tables)."""
    lines = docs.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("line", "s"))
    order = Window.partitionBy("key").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    piped = F.trim("s").startswith("|")
    title = F.last(F.when(~piped, _found(F.col("s"), r"^#{1,3}\s+(.+)", 1)), ignorenulls=True).over(before)
    first = piped & ~F.coalesce(F.lag(piped).over(order), F.lit(False))
    return lines.select("key", "line", "s", statement_of_title(F.regexp_replace(title, "[#*`]", "")).alias("kind"), F.when(piped, F.sum(first.cast("int")).over(before)).alias("block"))


def _rows(lines: DataFrame) -> DataFrame:
    """key, block, kind, line, r (0: the header) and cells of the tables under a statement's heading, without rules."""
    inner = F.substring(F.regexp_replace(F.trim("s"), r"(?<=.)\|$", ""), 2, 1 << 30)
    rows = lines.where("block is not null and kind is not null").withColumn("cells", F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c)))
    rule = F.forall("cells", lambda c: F.regexp_replace(c, r"\s", "").rlike("^:?-{2,}:?$"))
    place = F.row_number().over(Window.partitionBy("key", "block").orderBy("line")) - 1
    return rows.where(~rule).select("key", "block", "kind", "line", place.alias("r"), "cells")


def _place(cells: Column, pattern: str) -> Column:
    """The first cell that is such a word, -1 for none."""
    return F.coalesce(F.array_min(F.filter(F.transform(cells, lambda c, i: F.when(_strip(c).rlike(pattern), i)), lambda i: i.isNotNull())), F.lit(-1))


def repair_statements(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """key and text of each document, with the printed numbers of its statements as the facts have them.

    docs: key (unique), text. facts: key, kind (is, bs, cf), concept, period, value, pos (order; of several facts that
    fit a column the first counts). Tables under a statement's heading whose header names a concept column are put
    right where the concept (with a colon) and the column's period have a fact; nothing is invented. Those tables are
    written anew, cells padded to one width; all other lines stay, line ends become line feeds. Documents without facts
    stay as they are; a null text is empty."""
    with_facts = docs.join(facts.select("key").distinct(), "key", "left_semi")
    lines = _lines(with_facts)
    rows = _rows(lines)
    tables = rows.groupBy("key", "block").agg(F.max(F.size("cells")).alias("width"), F.min_by("cells", "r").alias("head"))
    tables = tables.select("key", "block", "width", "head", _place(F.col("head"), "(?i)^concept$").alias("concept_at"), _place(F.col("head"), r"(?i)^line(\s+item)?$").alias("line_at"))
    held = rows.join(tables, ["key", "block"])
    concept = _strip(F.get("cells", F.col("concept_at")))
    cells = held.where((F.col("r") > 0) & (F.col("concept_at") >= 0)).withColumn("concept", concept).where(F.col("concept").contains(":"))
    cells = cells.select("key", "kind", "block", "r", "concept", "concept_at", "line_at", F.posexplode("head").alias("i", "title")).where((F.col("i") != F.col("concept_at")) & (F.col("i") != F.col("line_at")))
    wanted = cells.select("key", "kind", "block", "r", "concept", "i", F.explode(header_period_names(_strip(F.col("title")))).alias("name"))
    told = facts.where("value is not null").select("key", "kind", "concept", "pos", "value", F.explode(fact_period_names(F.col("period"))).alias("name"))
    best = wanted.join(told, ["key", "kind", "concept", "name"]).groupBy("key", "block", "r", "i").agg(F.min_by("value", "pos").alias("value"))
    changes = best.groupBy("key", "block", "r").agg(F.map_from_entries(F.collect_list(F.struct("i", printed_money(F.col("value")).alias("told")))).alias("changes"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    fixed = F.transform(padded, lambda c, i: F.coalesce(F.try_element_at("changes", i), c))
    bar = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n"), bar(F.array_repeat(F.lit("---"), F.col("width"))))
    new = held.join(changes, ["key", "block", "r"], "left").select("key", "line", F.concat(bar(fixed), F.when(F.col("r") == 0, rule).otherwise("")).alias("new"))
    # rules of rewritten tables go; a table of nothing but rules stays
    rewritten = tables.select("key", "block", F.lit(True).alias("whole"))
    out = lines.join(new, ["key", "line"], "left").join(rewritten, ["key", "block"], "left").where("new is not null or whole is null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("new", "s").alias("s")))), lambda x: x["s"]), "\n")
    repaired = out.groupBy("key").agg(text.alias("text"))
    return repaired.unionByName(docs.join(facts.select("key").distinct(), "key", "left_anti").select("key", F.coalesce("text", F.lit("")).alias("text")))


def check_statements(docs: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per fact: key, pos, kind, concept, period, value, printed, status, hint.

    facts as in repair_statements(), with line (the concept's printed name). The last table under a statement's heading
    counts. status: no table; no period (no column); no line (no row whose name is, holds or lies in the fact's line
    or another line of its concept; of several the first row); no number; right; wrong. hint for wrong ones: sign,
    thousands or millions, where that alone explains the difference."""
    rows = _rows(_lines(docs))
    last = rows.groupBy("key", "kind").agg(F.max("block").alias("block"))
    grid = rows.join(last, ["key", "kind", "block"]).groupBy("key", "kind").agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("g"))
    grid = grid.select("key", "kind", F.transform(F.element_at("g", 1)["cells"], lambda c: header_period_names(c)).alias("titles"), F.transform(F.slice("g", F.lit(2), F.size("g")), lambda x: F.struct(label(F.get(x["cells"], F.lit(0))).alias("name"), x["cells"].alias("cells"))).alias("body"))
    lines = facts.groupBy("key", "kind", "concept").agg(F.array_remove(F.collect_set(label(F.col("line"))), "").alias("lines"))
    f = facts.where("value is not null").join(lines, ["key", "kind", "concept"], "left").join(grid, ["key", "kind"], "left").withColumn("names", fact_period_names(F.col("period")))
    column = F.array_min(F.filter(F.transform("titles", lambda t, i: F.when((i > 0) & F.arrays_overlap(t, F.col("names")), i)), lambda i: i.isNotNull()))
    alike = lambda a, b: a.contains(b) | b.contains(a)
    fits = F.filter("body", lambda b: (b["name"] != "") & F.exists("lines", lambda n: alike(b["name"], n)))
    f = f.withColumns({"column": column, "row": F.try_element_at(fits, F.lit(1))}).withColumn("printed", printed_number(F.get("row.cells", F.col("column"))))
    off = lambda v: F.abs(v - F.col("value")) <= tolerance
    near = lambda scale: F.abs(F.col("printed") * scale - F.col("value")) <= scale / 2
    status = F.when(F.coalesce(F.size("body"), F.lit(0)) == 0, "no table").when(F.col("column").isNull(), "no period").when(F.col("row").isNull(), "no line").when(F.col("printed").isNull(), "no number").when(off(F.col("printed")), "right").otherwise("wrong")
    hint = F.when(off(-F.col("printed")), "sign").when(near(1000.0), "thousands").when(near(1e6), "millions")
    return f.withColumn("status", status).select("key", "pos", "kind", "concept", "period", "value", "printed", "status", F.when(F.col("status") == "wrong", hint).alias("hint"))


def missing_concepts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """key, kind, concept of the concepts with a line none of whose names is, holds or lies in the name of a row of the
    statement's last table; all of a statement without a table."""
    rows = _rows(_lines(docs))
    last = rows.groupBy("key", "kind").agg(F.max("block").alias("block"))
    names = rows.join(last, ["key", "kind", "block"]).where("r > 0").groupBy("key", "kind").agg(F.collect_set(label(F.get("cells", F.lit(0)))).alias("names"))
    lines = facts.groupBy("key", "kind", "concept").agg(F.array_remove(F.collect_set(label(F.col("line"))), "").alias("lines")).where(F.size("lines") > 0)
    there = F.exists("lines", lambda n: F.exists("names", lambda m: (m != "") & (m.contains(n) | n.contains(m))))
    return lines.join(names, ["key", "kind"], "left").where(~F.coalesce(there, F.lit(False))).select("key", "kind", "concept")
