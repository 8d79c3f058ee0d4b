"""Statement workbooks: untyped grids from XLSX files, header rows, and long facts.

Spark reads the files (binaryFile) and deals them out; a small helper turns one file's bytes into rows of cells, and
everything after that is column expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import periods, rules
from tallyframe.session import ship

GRID = "source_file string, sheet string, row_pos int, cells array<string>, error string"
# fixed values: tab names of statements, and phrases in tab names, the first that fits
TAB_NAMES = {"income statement": "income_statement", "balance sheet": "balance_sheet", "cash flow": "cash_flow", "cash flow statement": "cash_flow", "cash flows": "cash_flow"}
TAB_PHRASES = [
    ("statement of operations", "income_statement"),
    ("statements of operations", "income_statement"),
    ("statements of income", "income_statement"),
    ("consolidated income", "income_statement"),
    ("statement of cash flows", "cash_flow"),
    ("statements of cash flows", "cash_flow"),
    ("consolidated balance sheet", "balance_sheet"),
    ("financial position", "balance_sheet"),
]


def is_annual_report(name: Column) -> Column:
    return name.rlike(r"(?i)10[_\-\s]?K")


def statement_of(tab: Column) -> Column:
    """income_statement, balance_sheet, cash_flow or null: by the tab's whole name, else by a phrase in it. Letters,
    digits and blanks count, in any case."""
    name = F.trim(F.regexp_replace(F.lower(tab), r"[^a-z0-9\s]", ""))
    exact = None
    for text, statement in TAB_NAMES.items():
        exact = F.when(name == text, statement) if exact is None else exact.when(name == text, statement)
    return F.coalesce(exact, rules.first_rule(name, TAB_PHRASES, None))


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of an XLSX file; cells as text, null where empty."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", ns):
            part = targets[sheet.get(rel)].lstrip("/")
            root = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            for n, row in enumerate(root.iterfind("m:sheetData/m:row", ns), start=1):
                cells: list[str | None] = []
                for c in row.iterfind("m:c", ns):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [None] * (at - 1 - len(cells)) if at else []
                    v = c.find("m:v", ns)
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    elif v is None or v.text is None:
                        text = None
                    else:
                        text = shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells.append(text)
                yield sheet.get("name"), int(row.get("r") or n), cells


def read_grids(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of every workbook in a folder. A file that can't be read gives one row with its error."""
    ship(spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = unquote(path.rsplit("/", 1)[-1])  # paths come as URLs
                try:
                    out = [(name, s, r, c, None) for s, r, c in sheet_rows(content)]
                except Exception as e:  # a bad file is a row of its own, the others are read
                    out = [(name, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["source_file", "sheet", "row_pos", "cells", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")
    return files.mapInPandas(rows, GRID)


def header_rows(grid: DataFrame, most: int = 10) -> DataFrame:
    """Per sheet the first of its first rows with a cell 'concept' and a period: source_file, sheet, header_pos, header."""
    is_concept = F.exists("cells", lambda c: F.lower(F.trim(c)) == "concept")
    is_period = F.exists("cells", lambda c: periods.period_type(c).isNotNull())
    rows = grid.where((F.col("row_pos") <= most) & F.coalesce(is_concept & is_period, F.lit(False)))
    return rows.groupBy("source_file", "sheet").agg(F.min("row_pos").alias("header_pos"), F.min_by("cells", "row_pos").alias("header"))


def grid_facts(grid: DataFrame) -> DataFrame:
    """Long facts: stmt, concept, label, depth, period, source_file, sheet, row_pos, value. Sheets whose tab names no
    statement are left out, and cells that are no numbers. Lines with a label but no concept get a key of their own."""
    rows = grid.where("error is null").withColumn("stmt", statement_of(F.col("sheet"))).where("stmt is not null")
    rows = rows.join(header_rows(grid), ["source_file", "sheet"]).where("row_pos > header_pos")
    at = lambda name: F.get("cells", (F.array_position(F.transform("header", lambda h: F.lower(F.trim(h))), name) - 1).cast("int"))
    concept, label = (F.trim(F.coalesce(at(n), F.lit(""))) for n in ("concept", "line"))
    own = F.concat(F.lit("_:lineonly:"), "source_file", F.lit("|"), "sheet", F.lit("|R"), F.col("row_pos").cast("string"))
    named = rows.withColumn("label", label).withColumn("concept", F.when(concept != "", concept).when(label != "", own)).withColumn("depth", at("depth").try_cast("int"))
    cells = named.where("concept is not null").select("stmt", "concept", "label", "depth", "source_file", "sheet", "row_pos", F.explode(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c"))).alias("x"))
    value = F.col("x.c").try_cast("double")
    return cells.where(periods.period_type(F.col("x.h")).isNotNull() & value.isNotNull()).select("stmt", "concept", "label", "depth", F.upper(F.trim("x.h")).alias("period"), "source_file", "sheet", "row_pos", value.alias("value"))
