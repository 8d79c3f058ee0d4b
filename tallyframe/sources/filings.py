"""Filing sources: company facts and submissions as JSON, XBRL as XML, feeds, tables in HTML and Markdown.

Network services are read through files that a fetcher has stored; a source is a reader of such a folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.keep import keep_first
from tallyframe.session import ship

CELL = "struct<val:double,end:string,start:string,fy:int,fp:string,form:string,filed:string,frame:string,accn:string>"
COMPANY_FACTS = f"cik string, facts map<string,map<string,struct<label:string,units:map<string,array<{CELL}>>>>>"


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Cells of company facts files, one row each. Cells without a finite value or a date as end are left out."""
    raw = spark.read.schema(COMPANY_FACTS).option("multiLine", True).json(path)
    tags = raw.select("cik", F.explode("facts").alias("namespace", "tags")).select("cik", "namespace", F.explode("tags").alias("tag", "t"))
    units = tags.select("cik", "namespace", "tag", F.col("t.label").alias("label"), F.explode("t.units").alias("unit", "cells"))
    cells = units.select("cik", "namespace", "tag", "label", "unit", F.inline("cells")).withColumnRenamed("val", "value")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return cells.where(finite & F.col("end").rlike(r"^\d{4}-\d{2}-\d{2}$"))


SUBMISSIONS = "cik string, filings struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>>>"


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filings from files of parallel arrays (history chunks are more such files): one row per (accession, document),
    the first read by date, with the URL of the document."""
    raw = spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)
    r = F.col("filings.recent")
    rows = raw.select("cik", F.inline(F.arrays_zip(r["accessionNumber"].alias("accession"), r["filingDate"].alias("filed"), r["form"].alias("form"), r["primaryDocument"].alias("document"))))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.regexp_replace("accession", "-", ""), F.lit("/"), "document")
    return keep_first(rows.withColumn("url", url), ["accession", "document"], ["filed", "form", "cik"])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xbrl_items(xml: bytes) -> Iterator[tuple]:
    """(kind, id, a, b, unit, value, n) of an instance: contexts (start, end, dimensions), units (measure) and facts
    (concept, context, unit, number). Facts that are nil or no numbers are left out; sign '-' negates."""
    pos = 0
    for e in ElementTree.fromstring(xml):
        name = _local(e.tag)
        if name == "context":
            dates = {_local(x.tag): (x.text or "").strip() for x in e.iter() if _local(x.tag) in ("instant", "startDate", "endDate")}
            dims = sum(_local(x.tag) in ("explicitMember", "typedMember") for x in e.iter())
            yield "context", e.get("id"), dates.get("startDate"), dates.get("instant") or dates.get("endDate"), None, None, dims
        elif name == "unit":
            yield "unit", e.get("id"), next(((x.text or "").strip() for x in e.iter() if _local(x.tag) == "measure"), None), None, None, None, 0
        elif e.get("contextRef"):
            pos += 1
            if any(k.endswith("nil") and v == "true" for k, v in e.attrib.items()):
                continue
            try:
                value = float((e.text or "").replace(",", ""))
            except ValueError:
                continue
            yield "fact", name, e.get("contextRef"), None, e.get("unitRef"), -value if e.get("sign") == "-" else value, pos


def linkbase_items(xml: bytes) -> Iterator[tuple]:
    """(kind, role, from, to, weight, order, text) of a linkbase: locators, arcs and labels."""
    x = "{http://www.w3.org/1999/xlink}"
    for link in ElementTree.fromstring(xml):
        role = link.get(f"{x}role")
        for e in link:
            name = _local(e.tag)
            if name == "loc":
                yield "loc", role, e.get(f"{x}label"), (e.get(f"{x}href") or "").rsplit("#", 1)[-1], None, None, None
            elif name.endswith("Arc"):
                yield "arc", role, e.get(f"{x}from"), e.get(f"{x}to"), float(e.get("weight") or 1), float(e.get("order") or 0), e.get("preferredLabel")
            elif name == "label":
                yield "label", e.get(f"{x}role"), e.get(f"{x}label"), None, None, None, (e.text or "").strip()


def _parsed(files: DataFrame, parse, columns: str) -> DataFrame:
    """path and the parsed rows of each file; a file that isn't well formed gives none."""
    ship(files.sparkSession)
    names = ["path", *[c.split()[0] for c in columns.split(", ")]]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out = [(path, *r) for r in parse(content)]
                except ElementTree.ParseError:
                    out = []
                yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(rows, f"path string, {columns}")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def xbrl_instance(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contexts, units and facts of instance files (path, content)."""
    items = _parsed(files, xbrl_items, "kind string, id string, a string, b string, unit string, value double, n int")
    contexts = items.where("kind = 'context'").select("path", F.col("id").alias("context_ref"), F.col("a").alias("start"), F.col("b").alias("end"), F.col("n").alias("dim_count"))
    units = items.where("kind = 'unit'").select("path", F.col("id").alias("unit_ref"), F.col("a").alias("measure"))
    facts = items.where("kind = 'fact'").select("path", F.col("id").alias("concept"), F.col("a").alias("context_ref"), F.col("unit").alias("unit_ref"), "value", F.col("n").alias("pos"))
    return contexts, units, facts


def linkbase_arcs(files: DataFrame) -> DataFrame:
    """Arcs between concepts: path, role, parent, child, weight, ord, preferred_label."""
    items = _parsed(files, linkbase_items, "kind string, role string, a string, b string, weight double, ord double, text string")
    locs = items.where("kind = 'loc'").select("path", "role", "a", F.col("b").alias("concept"))
    arcs = items.where("kind = 'arc'").select("path", "role", "a", F.col("b").alias("to"), "weight", "ord", F.col("text").alias("preferred_label"))
    parents = locs.select("path", "role", "a", F.col("concept").alias("parent"))
    children = locs.select("path", "role", F.col("a").alias("to"), F.col("concept").alias("child"))
    return arcs.join(parents, ["path", "role", "a"]).join(children, ["path", "role", "to"]).select("path", "role", "parent", "child", "weight", "ord", "preferred_label")


def linkbase_labels(files: DataFrame) -> DataFrame:
    """The label of each concept and label role: of several the first text."""
    items = _parsed(files, linkbase_items, "kind string, role string, a string, b string, weight double, ord double, text string")
    locs = items.where("kind = 'loc'").select("path", "a", F.col("b").alias("concept"))
    arcs = items.where("kind = 'arc'").select("path", "a", F.col("b").alias("to"))
    labels = items.where("kind = 'label'").select("path", F.col("a").alias("to"), F.col("role").alias("label_role"), "text")
    joined = locs.join(arcs, ["path", "a"]).join(labels, ["path", "to"]).select("path", "concept", "label_role", "text", "to")
    return keep_first(joined, ["path", "concept", "label_role"], ["to", "text"]).drop("to")


FEED = "title string, link string, published string, summary string, pos int"


def feed_items(xml: bytes) -> Iterator[tuple]:
    for n, e in enumerate(x for x in ElementTree.fromstring(xml).iter() if _local(x.tag) in ("item", "entry")):
        got = {_local(c.tag): (c.text or c.get("href") or "").strip() for c in e}
        yield got.get("title"), got.get("link"), got.get("pubDate") or got.get("published") or got.get("updated"), got.get("description") or got.get("summary"), n


def feeds(files: DataFrame) -> DataFrame:
    """Items of RSS and Atom files."""
    return _parsed(files, feed_items, FEED)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.n, self.row, self.cell, self.rows, self.open = 0, None, None, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.n += 1
            self.open.append(self.n)
        elif tag == "tr" and self.open:
            self._end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self._end_cell()
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()
            if tag == "table" and self.open:
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.row:
            self.rows.append((self.open[-1] if self.open else self.n, len(self.rows), self.row))
        self.row = None


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of the tables in pages: key, table (1, 2, ... in page order), row_pos, cells."""
    ship(pages.sparkSession)
    key_type = pages.schema[key].dataType.simpleString()

    @F.pandas_udf("array<struct<table:int,row_pos:int,cells:array<string>>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> list:
            p = _Tables()
            p.feed(text or "")
            p.close()
            p._end_row()
            return [{"table": t, "row_pos": i, "cells": r} for t, i, r in p.rows]

        return s.map(one, na_action=None)

    return pages.select(F.col(key).cast(key_type).alias(key), F.inline(parse(F.coalesce(html, F.lit("")))))


def markdown_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of pipe tables: key, table (1, 2, ... in order), line, cells. Separator rows are left out; a line without
    pipes ends a table. A text's lines are its own group."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "s"))
    is_row = F.trim("s").rlike(r"^\|.*\|$")
    w = Window.partitionBy(key).orderBy("line")
    first = is_row & ~F.coalesce(F.lag(is_row).over(w), F.lit(False))
    numbered = lines.withColumn("r", is_row).withColumn("table", F.sum(first.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.transform(F.split(F.regexp_replace(F.trim("s"), r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))
    return numbered.where(F.col("r") & ~F.trim("s").rlike(r"^\|[\s:|-]+\|$")).select(key, F.col("table").cast("int").alias("table"), "line", cells.alias("cells"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; lines that aren't give nulls in every column."""
    return spark.read.schema(schema).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).withColumn("path", F.col("_metadata.file_path"))
