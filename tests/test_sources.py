"""Sources, sinks and the stream over small files."""

import json
import zipfile

from pyspark.sql import functions as F

from tallyframe.sources import filings as src
from tallyframe.sources import search, sinks, workbooks
from tallyframe.streaming import daily

XL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{XL}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' for c, v in enumerate(row) if v is not None
                )
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{XL}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    write_xlsx(tmp_path / "a 10-K.xlsx", {"Income Statement": [["title"], ["Concept", "Line", "FY20", "1Q20"], ["us:Revenue", "Revenue", 100, "—"], [None, "Loose line", 5, 2.5]], "Notes": [["Concept", "FY20"], ["x", 1]]})
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    grid = workbooks.read_grids(spark, str(tmp_path)).cache()
    assert grid.where("error is not null").select("source_file").first()[0].startswith("bad")
    out = [(r.concept, r.period, r.value) for r in workbooks.grid_facts(grid).orderBy("row_pos", "period").collect()]
    assert out == [("us:Revenue", "FY20", 100.0), ("_:lineonly:a 10-K.xlsx|Income Statement|R4", "1Q20", 2.5), ("_:lineonly:a 10-K.xlsx|Income Statement|R4", "FY20", 5.0)]


def test_company_facts_and_submissions(spark, tmp_path):
    cells = [{"val": 5, "end": "2020-12-31", "fy": 2020, "fp": "FY", "form": "10-K", "filed": "2021-02-01"}, {"val": None, "end": "2020-12-31"}, {"val": 1, "end": "bad"}]
    (tmp_path / "f.json").write_text(json.dumps({"cik": "1", "facts": {"us-gaap": {"Assets": {"label": "Assets", "units": {"USD": cells}}}}}))
    assert [(r.tag, r.unit, r.value) for r in src.company_facts(spark, str(tmp_path / "f.json")).collect()] == [("Assets", "USD", 5.0)]
    (tmp_path / "s.json").write_text(json.dumps({"cik": "0001", "filings": {"recent": {"accessionNumber": ["1-2", "1-2"], "filingDate": ["2021-01-02", "2021-01-02"], "form": ["10-K", "10-K"], "primaryDocument": ["d.htm", "d.htm"]}}}))
    (r,) = src.submissions(spark, str(tmp_path / "s.json")).collect()
    assert r.url.endswith("/data/1/12/d.htm")


def test_xbrl(spark, tmp_path):
    (tmp_path / "i.xml").write_text(
        '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:g="urn:g" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><context id="c"><period><startDate>2020-01-01</startDate><endDate>2020-12-31</endDate></period></context>'
        '<unit id="u"><measure>iso4217:USD</measure></unit><g:Revenue contextRef="c" unitRef="u">1,000</g:Revenue><g:Cost contextRef="c" unitRef="u" sign="-">5</g:Cost><g:Nil contextRef="c" xsi:nil="true"/></xbrl>'
    )
    contexts, units, facts = src.xbrl_instance(src.binary_files(spark, str(tmp_path), "i.xml"))
    assert contexts.first().end == "2020-12-31" and units.first().measure == "iso4217:USD"
    assert {r.concept: r.value for r in facts.collect()} == {"Revenue": 1000.0, "Cost": -5.0}
    (tmp_path / "c.xml").write_text(
        '<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><calculationLink xlink:role="r"><loc xlink:label="a" xlink:href="x#Parent"/><loc xlink:label="b" xlink:href="x#Child"/>'
        '<calculationArc xlink:from="a" xlink:to="b" weight="-1" order="2"/></calculationLink></linkbase>'
    )
    (arc,) = src.linkbase_arcs(src.binary_files(spark, str(tmp_path), "c.xml")).collect()
    assert (arc.parent, arc.child, arc.weight, arc.ord) == ("Parent", "Child", -1.0, 2.0)
    (tmp_path / "l.xml").write_text(
        '<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><labelLink><loc xlink:label="a" xlink:href="x#Parent"/><label xlink:label="t" xlink:role="std">Parent item</label><labelArc xlink:from="a" xlink:to="t"/></labelLink></linkbase>'
    )
    (label,) = src.linkbase_labels(src.binary_files(spark, str(tmp_path), "l.xml")).collect()
    assert (label.concept, label.text) == ("Parent", "Parent item")


def test_feeds_and_tables(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://a</link><pubDate>d</pubDate></item></channel></rss>")
    assert src.feeds(src.binary_files(spark, str(tmp_path), "f.xml")).first().title == "T"
    pages = spark.createDataFrame([(1, "<table><tr><th>a<td> b  c </tr><tr><td>1</td></tr></table>"), (2, None)], "id int, html string")
    assert [(r.id, r.table, r.cells) for r in src.html_tables(pages, "id", "html").orderBy("row_pos").collect()] == [(1, 1, ["a", "b c"]), (1, 1, ["1"])]
    docs = spark.createDataFrame([(1, "x\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c |\n")], "id int, t string")
    assert [(r.table, r.cells) for r in src.markdown_tables(docs, "id", "t").orderBy("line").collect()] == [(1, ["a", "b"]), (1, ["1", "2"]), (2, ["c"])]


def test_search_source(spark):
    def good(query):
        yield {"id": "1", "title": query, "url": "u"}

    def bad(query):
        raise TimeoutError("slow")

    search.register(spark, {"good": good, "bad": bad}, "fake_search")
    out = {r.provider: (r.title, r.error) for r in spark.read.format("fake_search").option("query", "q").load().collect()}
    assert out == {"good": ("q", None), "bad": (None, "TimeoutError: slow")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).where("k = 1").first().v == 'a "b", c'
    sinks.append_jsonl(df, str(tmp_path / "j"))
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert src.jsonl(spark, str(tmp_path / "j"), "k int, v string").count() == 4
    sinks.replace_partitions(df, str(tmp_path / "p"), ["k"])
    sinks.replace_partitions(df.where("k = 2").withColumn("v", F.lit("new")), str(tmp_path / "p"), ["k"])
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {1: 'a "b", c', 2: "new"}
    sinks.upsert_table(df, str(tmp_path / "t0"), str(tmp_path / "t1"), ["k"], "v")
    sinks.corpus_bundle(df, str(tmp_path / "b"), "k")
    assert spark.read.json(str(tmp_path / "b/manifest")).first().n_chunks == 2


def test_daily_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "u", 1.0), (1, "2024-01-01 10:00:00", "u", 1.0), (2, "2024-01-01 11:00:00", "u", 5.0)]
    df = spark.createDataFrame(rows, "id long, at string, who string, value double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily.upsert_batches(daily.fresh_events(stream, "id", "at"), str(tmp_path / "out"), str(tmp_path / "cp"), ["who"], "id", "at")
    q.awaitTermination(120)
    (r,) = spark.read.schema("id long, who string, at timestamp, day string").parquet(str(tmp_path / "out")).collect()
    assert (r.who, r.id, r.day) == ("u", 2, "2024-01-01")
