"""Sections, notes, tables and zones of filings against plain pairings of every start with every end."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import sections as se

DASH = "[.—–-]"


def first(pattern, text, after):
    m = re.compile(pattern, re.I | re.A).search(text[after:])
    return after + m.start() if m else None


def brute_end(text, start, annual):
    tail = start + 1
    if annual:
        found = [(first(rf"\bITEM\s+7A{DASH}\s*QUANTITATIVE\b", text, tail), "Item 7A")]
        hits = [m.start() for m in re.finditer(r"\bITEM\s+8[.—-]\s*FINANCIAL\s+STATEMENTS\b", text, re.I | re.A) if m.start() >= tail]
        found.append((next((x for x in hits if not se._cited(text, x)), None), "Item 8"))
    else:
        found = [(first(p, text, tail), label) for label, p in (("Item 3", rf"\bITEM\s+3{DASH}\s*QUANTITATIVE\b"), ("Item 4", rf"\bITEM\s+4{DASH}\s*(?:CONTROLS|MINE\s+SAFETY)"), ("Item 1 Legal", rf"\bITEM\s+1{DASH}\s*LEGAL\s+PROCEEDINGS\b"))]
        for label, p in (("Item 3 (heading)", rf"\bITEM\s+3{DASH}"), ("Item 4 (heading)", rf"\bITEM\s+4{DASH}"), ("Part II", r"\bPART\s+II\b"), ("Signatures", r"\bSIGNATURES?\b")):
            x = first(p, text, tail)
            if x is not None and x - start >= 3400 and (label != "Signatures" or x - tail > 120):
                found.append((x, label))
        if not any(x is not None for x, _ in found):
            x = first(r"\bITEM\s+3\b", text, tail)
            found.append((x if x is not None and x - start >= 3400 else None, "Item 3 (weak)"))
    found = [f for f in found if f[0] is not None]
    return min(found, key=lambda f: f[0]) if found else (len(text), "(eof)")


def brute_bounds(text, form):
    annual = "10-K" in form
    n, least, offset = ("7", 4000, 12_000) if annual else ("2", 1500, 5000)
    cue = lambda at: re.search(se.CUE, text[at : at + 2500], re.I | re.A)
    loose = lambda at: cue(at) or re.search(se.LOOSE_CUE, text[at : at + 3200], re.I | re.A)
    titles = [p for p in se.STARTS["10-K" if annual else "10-Q"]]
    item = rf"\bITEM\s+{n}{DASH}"

    def spans(patterns, early, word, shortest, head=None):
        for p in patterns:
            for m in re.finditer(p, text, re.I | re.A):
                at = m.start()
                if re.match(rf"item\s+{n}\s+of\b", text[at:], re.I) or se._contents_row(text, at) or at < early and not word(at):
                    continue
                if head and not re.search(head[1], text[at : at + head[0]], re.I | re.A):
                    continue
                end, label = brute_end(text, at, annual)
                if end - at >= shortest:
                    yield at, end, label

    passes = [lambda: spans(titles, offset, cue, least), lambda: spans([item], offset, cue, least, se.HEADS[0])]
    if not annual:
        passes += [lambda: [*spans(titles, 3200, loose, 600), *spans([item], 3200, loose, 600, se.HEADS[1])], lambda: spans([item], 1400, loose, 600, se.HEADS[2])]
    for p in passes:
        found = list(p())
        if found:
            start, end, label = max(found, key=lambda f: f[1] - f[0])
            return start, end, label, "low" if not cue(start) else "medium" if start < offset else "high"
    return None


PIECES = [
    "ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS ", "Item 7 Management's Discussion and Analysis ", "ITEM 7. ", "item 7 of the report ", "ITEM 7A. QUANTITATIVE ", "Item 8. Financial Statements and Supplementary Data, ",
    "ITEM 8. FINANCIAL STATEMENTS AND SUPPLEMENTARY DATA The ", "Item 2. Management's Discussion and Analysis of Financial Condition and Results of Operations ", "ITEM 2. MD&A ", "Item 2. ", "Part I Item 2. Management's Discussion ", "ITEM 3. QUANTITATIVE ", "Item 3. ", "ITEM 4. CONTROLS ", "Item 4- ",
    "PART II ", "SIGNATURES ", "Item 1. Legal Proceedings ", "Item 3 ", "page 12 ", "results of operations ", "liquidity ", "revenue ", "overview ",
]


def test_discussion_bounds_against_every_pairing(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        text = "".join(rng.choice([rng.choice(PIECES), "plain words " * rng.choice([1, 5, 60, 400])]) for _ in range(rng.randrange(1, 40)))
        rows.append((i, text, rng.choice(["10-K", "10-K/A", "10-Q", "10-Q", "8-K", None])))
    rows += [(900, None, "10-K"), (901, "", "10-Q"), (902, ("ITEM 2. MD&A " + "x " * 400) * 400, "10-Q")]
    df = spark.createDataFrame(rows, "key long, text string, form string").withColumn("at", F.lit("clash"))
    got = {r.key: (r.start, r.end, r.end_label, r.confidence) for r in se.discussion_bounds(df).collect()}
    want = {k: b for k, t, f in rows if (b := brute_bounds(t or "", f or "")) is not None}
    assert got == want
    assert len({(b[2], b[3]) for b in got.values()}) > 8


def test_notes_and_segments(spark):
    body = "words " * 300
    text = f"Item 8. Financial Statements and Supplementary Data, see. {body}ITEM 8. FINANCIAL STATEMENTS AND DATA {body}Notes to Consolidated Financial Statements {body}Note 1 Basis {body}(2) Operating Segments reportable segment {body}(1) inner {body}(2) again {body}(3) Debt {body}ITEM 9. Other {body}"
    rows = [(1, text, "10-K"), (2, text, "10-Q"), (3, "Notes to Financial Statements", "10-Q"), (4, None, None), (5, f"{body}{body}Notes to Interim Financial Statements {body}Business Segments {body}", "10-Q")]
    df = spark.createDataFrame(rows, "key long, text string, form string")
    notes = {r.key: r for r in se.notes_bounds(df).collect()}
    assert set(notes) == {1, 2, 5} and notes[1].start == text.index("Notes to Cons") and text[notes[1].end :].startswith("ITEM 9") and notes[1].heading_found
    assert notes[2].end == len(text)
    found = {r.key: r for r in se.segment_bounds(df, se.notes_bounds(df)).collect()}
    assert text[found[1].start : found[1].end].startswith("(2) Operating") and text[found[1].end :].startswith("(3) Debt") and found[1].confidence == "high"
    assert (found[5].points, found[5].confidence) == (44.0, "medium") and found[5].start == rows[4][1].index("Business Segments") - 700


def test_note_blocks_against_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice([f"({rng.randrange(0, 9)}) ", f"Note {rng.randrange(1, 9)} ", "(1999) ", "word ", "(12A) "]) for _ in range(rng.randrange(30)))
        marks = sorted([(m.start(), "note", int(m[1])) for m in re.finditer(r"\bNote (\d+)\b", text)] + [(m.start(), "paren", int(m[1])) for m in re.finditer(r"\((\d{1,3})[A-Z]?\) ", text) if int(m[1])])
        ends = [next((b for b, kind, k in marks[i + 1 :] if kind == "note" or k > n), len(text)) for i, (_, _, n) in enumerate(marks)]
        assert [(x["start"], x["end"]) for x in se.note_blocks(text, 0, len(text))] == [(m[0], e) for m, e in zip(marks, ends)]


def test_tables_in_zones(spark):
    html = "<p>one&nbsp; two</p><script>x</script><table><tr><td>a</td><th>b<b>c</b></td></tr></table> three <table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>"
    text, tables = se.flat_page(html)
    assert text == "one two a b c three in" and tables == [(7, [["a", "b c"]]), (19, [[""]]), (19, [["in"]])]
    body = "<p>" + "results of operations and words " * 500 + "</p>"
    page = f"{body}<h1>ITEM 7. Management's Discussion and Analysis of Financial Condition and Results of Operations</h1>{body}<table><tr><td>1</td></tr></table>{body}<h1>ITEM 8. Financial Statements</h1><table><tr><td>2</td></tr></table><h2>Notes to Consolidated Financial Statements</h2>{body}<p>(3) Segment Information reportable segment</p><table><tr><td>3</td></tr></table>{body}"
    df = spark.createDataFrame([(1, page, "10-K"), (2, None, "10-K"), (3, "<table>", None)], "key long, html string, form string")
    got = sorted((r.key, r.number, r.zone, r.rows) for r in se.table_zones(df, width=1000).collect())
    assert got == [(1, 0, "discussion", [["1"]]), (1, 2, "segments", [["3"]])]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_points_in_zones_against_all_pairs(spark, width):
    rng = random.Random(width)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, rng.randrange(100)]), i) for i in range(300)]  # one key has most
    zones = [(rng.choice([1, 2, 3, None]), a := rng.randrange(-20, 100), a + rng.randrange(-2, 60), i) for i in range(40)] + [(1, None, 5, 99), (1, 0, None, 98)]
    got = se.points_in_zones(spark.createDataFrame(points, "key int, at long, point int"), spark.createDataFrame(zones, "key int, start long, end long, zone int"), "key", "at", "start", "end", width)
    want = sorted((p, z) for k, at, p in points for kk, a, b, z in zones if None not in (k, at, a, b) and k == kk and a <= at < b)
    assert sorted((r.point, r.zone) for r in got.collect()) == want


def test_dollar_cells(spark):
    cases = [(["$", "5", "x"], ["$5", "x"]), (["$", "$ 5"], ["$ 5"]), ([" $ ", "(1,2)", "$"], ["$(1,2)", "$"]), (["$", "x"], ["$", "x"]), (["$", "$", "5"], ["$", "5"]), ([], []), (["a", None], ["a", ""])]
    df = spark.createDataFrame([(a,) for a, _ in cases], "row array<string>")
    assert [list(r[0]) for r in df.select(se.merge_dollar_cells(F.col("row"))).collect()] == [b for _, b in cases]
