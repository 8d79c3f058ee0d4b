"""Debt footnotes against a plain pass over each filing's notes, and chains against one hop at a time."""

import random
import re

from pyspark.sql import functions as F

from tallyframe.operators import footnotes as fo


def brute_chain(head_next, links):
    out, seen, at = [], set(), head_next
    while at in links and at not in seen:
        seen.add(at)
        out.append(at)
        at = links[at]
    return out


def test_chains_against_one_hop_at_a_time(spark):
    rng = random.Random(1)
    heads, links = [], []
    for k in range(12):
        ids = [f"c{i}" for i in range(rng.randrange(1, 40))]
        links += [(k, i, rng.choice([*ids, None, "gone"])) for i in ids]  # cycles, shared nodes, dead ends
        heads += [(k, h, rng.choice([*ids, "gone"])) for h in range(6)]
    links += [(99, f"n{i}", f"n{i + 1}") for i in range(700)]  # one long chain
    heads += [(99, 0, "n0"), (99, 1, "n650"), (100, 0, "none"), (None, 0, "n0")]
    path = fo.follow_chains(spark.createDataFrame(heads, "key long, head int, next string"), spark.createDataFrame(links, "key long, id string, next string"), "key")
    got = {}
    for r in sorted(path.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.key, r.head), []).append(r.id)
    want = {(k, h): c for k, h, n in heads if (c := brute_chain(n, {i: t for kk, i, t in links if kk == k}))}
    assert got == want


def test_tagged_blocks(spark):
    long = "the company has notes and loans outstanding of many kinds "
    html = (
        f'<ix:nonNumeric name="us-gaap:DebtDisclosureTextBlock" id="a" continuedAt="b"><p>{long}&amp;</p></ix:nonNumeric> between <ix:continuation id="b" continuedAt="c">second <b>part</b></ix:continuation>'
        '<ix:continuation continuedAt="b" id="c">third&nbsp;part</ix:continuation><ix:nonNumeric name="us-gaap:RevenueTextBlock">' + long + '</ix:nonNumeric><ix:nonnumeric name="x:TermLoan">short</ix:nonnumeric>'
        f"<ix:continuation id='c'>last\none stands</ix:continuation><ix:nonNumeric name='x:TermLoanAmount' contextRef='d'>{long}</ix:nonNumeric>"
    )
    df = spark.createDataFrame([(1, html), (2, None), (3, "no tags")], "key long, html string")
    got = [(r.key, r.concept, r.text, r.disclosure) for r in fo.tagged_blocks(df).orderBy("block").collect()]
    assert got == [(1, "us-gaap:DebtDisclosureTextBlock", long + "& second part last one stands", True), (1, "x:TermLoanAmount", long.strip(), False)]


# --- the driver ---

def norm(t):
    for p, r in ((r"(?i)&nbsp;|&#160;| ", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&"), ("[‒-―]", "-"), ("[\"“”‘’]", "'")):
        t = re.sub(p, r, t)
    return re.sub(r"\s+", " ", t.lower()).strip()


def brute_filing(text, blocks, reports, labels, patterns, found):
    has = lambda p, t: re.search(p, t, re.A) is not None
    notes = fo.notes_in(text, 0, len(text))
    rows = []
    for n in notes:
        h, b = norm(n["heading"]), norm(n["body"])
        tables = [norm(t.replace("|", " ")) for t in n["tables"]]
        full = bool(tables) or len(b.replace(" ", "")) >= 55
        rows.append({"n": n, "h": h, "b": b, "tables": tables, "full": full})
    if any(r["full"] for r in rows):
        rows = [r for r in rows if r["full"]]
    if not rows:
        return None

    def first_holding(t):
        probe = norm(t)[:200]
        return next((r for r in rows if probe[:80] in r["b"]), None) if len(probe) >= 28 else None

    def overlap(r, block):
        needle = block[0]
        for p, told in (("<[^>]+>", " "), ("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
            needle = re.sub(p, told, needle)
        needle = re.sub(r"\s+", " ", needle.lower()).strip()
        whole, part = (34, 18) if block[1] else (24, 12)
        if len(needle[:120]) < 44:
            return 0
        return whole if needle[:120] in r["b"] else part if needle[:72] in r["b"] else 0

    for r in rows:
        h, b = r["h"], r["b"]
        terms = [k for p, k in fo.BODY if has(p, b)]
        lines = max((sum(has(p, t) for p in fo.TABLE_LINES) for t in r["tables"]), default=0)
        r["table"] = 30 if lines >= 2 else 12 if lines else 0
        r["words"] = max((sum(len(re.findall(p, t, re.A)) for p in fo.TABLE_WORDS) for t in r["tables"] if len(t) >= 36), default=0)
        r["heading"], r["body"], r["terms"] = min(130, sum(k for p, k in fo.HEADING if has(p, h))), sum(terms), len(terms)
        neg = sum(k for p, k in fo.NEGATIVE_HEADING if has(p, h))
        if has(r"\bleases?\b", h) and not has(r"\bdebt\b|\bfinance\s+lease\b", h) and len(terms) < 2 and r["table"] < 30:
            neg += 20
        if has(r"\bfair\s+value\b", h) and not has(r"\bdebt\b|\bborrowings?\b", h) and r["table"] < 30:
            neg += 20
        if has(r"\bgoodwill\b|\bintangible\s+assets\b", h) and not has(r"\bdebt\b", h) and "accumulated other comprehensive" in b[:1600] and "goodwill" not in b[:2000]:
            neg += 135
        liquidity = "liquidity and capital resources"
        if liquidity in h or liquidity in b[:3200] and not has(r"\bnotes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements\b", b[:700]):
            neg += 100
        neg += 100 * sum(has(p, h) for p in (*fo.WRONG_HEADING, r"\bcontrols\s+and\s+procedures\b"))
        r["neg"], r["clear"] = neg, any(has(p, h) for p in fo.CLEAR_HEADING)
        r["indicators"] = sum(x in b for x in fo.INDICATORS) + 2 * has(fo.TABLE_HINTS, b)
        r["tagged"] = min(85, sum(overlap(r, x) for x in blocks))
        r["paths"], r["summary"], r["method"] = {"note_map"}, 0, 1
        if r["tagged"] >= 16:
            r["paths"].add("ixbrl_textblock")
        if any(has(p, b) for p in fo.ANCHORS) and r["n"]["end"] - r["n"]["start"] >= 140 and r["full"]:
            r["paths"].add("debt_table_anchor")
            r["method"] = 1 if r["clear"] else 3
    for block in blocks:
        if not any(overlap(r, block) >= 18 for r in rows) and (r := first_holding(block[0])):
            r["tagged"], r["method"] = min(85, max(40, r["tagged"])), max(4, r["method"])
            r["paths"].add("ixbrl_textblock")
    for t in reports:
        if r := first_holding(t):
            r["summary"], r["method"] = 46, 5
            r["paths"].add("filing_summary_report")
    for r in rows:
        r["sheet"] = min(52, 14 * sum(x in r["b"] for x in labels))
        best = 0
        for heading, number, names in patterns:
            s, dh = 0, re.sub(r"\s+", " ", heading).strip().lower()
            if len(dh) >= 6 and (dh[:48] in r["h"] or r["h"][:48] in dh):
                s += 38
            if abs(int(number) - int(re.sub(r"\D", "", r["n"]["note"]))) <= 2:
                s += 28
            s += 10 * sum(len(x.strip()) >= 8 and x.strip().lower() in r["b"] for x in names)
            best = max(best, s)
        r["prior"] = min(58, best)
        r["paths"] |= {"balance_sheet_crosscheck"} if r["sheet"] >= 12 else set()
        r["paths"] |= {"prior_period_learning"} if r["prior"] >= 22 else set()
        r["total"] = r["heading"] + r["body"] + r["table"] + r["tagged"] + r["summary"] + r["sheet"] + r["prior"] + min(22, 0.14 * r["words"]) - r["neg"]
    bonus = lambda r: 96 if has(r"\bnote\s+\d{1,2}[a-z]?[\s\-]{0,4}debt\b", r["h"]) else 0
    ranked = sorted(rows, key=lambda r: (-(r["total"] + bonus(r)), -r["total"], r["n"]["start"]))
    top = ranked[0]
    strong, n_paths = top["table"] >= 30 or top["words"] >= 22, len(top["paths"])
    wrong = any(has(p, top["h"]) for p in fo.WRONG_HEADING)
    if not found:
        sure = "Not Found" if top["total"] < 28 and top["terms"] < 2 and not strong else "Low"
    elif wrong and n_paths < 2:
        sure = "Low"
    elif top["neg"] >= 95:
        sure = "Medium" if top["terms"] >= 5 or strong or top["indicators"] >= 6 else "Low"
    elif n_paths >= 2 and (top["clear"] or strong) and (top["indicators"] >= 3 or top["terms"] >= 3) and top["neg"] < 70:
        sure = "High"
    elif top["terms"] >= 5 or top["indicators"] >= 6 or strong or top["method"] == 3 and (top["indicators"] >= 5 or top["terms"] >= 4):
        sure = "Low" if not top["clear"] and top["indicators"] < 4 and not strong and top["terms"] < 5 and n_paths < 2 else "Medium"
    else:
        sure = "Low" if top["terms"] >= 2 or top["indicators"] >= 3 or top["total"] >= 42 else "Not Found"
    method = {3: "debt_table_anchor", 5: "filing_summary_report", 4: "ixbrl_textblock"}.get(top["method"])
    method = method or ("direct_heading_match" if top["clear"] else "debt_table_keyword_match" if top["table"] >= 30 or top["words"] >= 24 else "xbrl_tag_fallback" if top["tagged"] >= 26 else "body_keyword_fallback")
    return top["n"]["note"], top["n"]["start"], top["n"]["end"], round(top["total"], 4), sure, method, sorted(top["paths"]), len(rows), round(ranked[1]["total"], 4) if len(rows) > 1 else None


HEADINGS = ["Debt", "Income Taxes", "Long-Term Debt, Net", "Leases", "Revenue", "Goodwill", "Borrowings", "Fair Value", "Pension", "Liquidity and Capital Resources", "Other", "Risk Factors", "Credit Facilities", "Exhibit Index"]
PHRASES = [
    "the credit agreement has a maturity date", "the term loan bears an interest rate", "notes payable and collateral", "total debt less: current portion", "accumulated other comprehensive income", "liquidity and capital resources", "plain words only", "secured notes and covenants of the lender",
    "notes to consolidated financial statements", "unsecured notes—due", "“senior notes” outstanding", "&nbsp;borrowings outstanding",
]


def made(rng):
    parts, bodies = ["Notes\n"] if rng.random() < 0.8 else [], []
    for i in range(rng.randrange(0, 7)):
        body = ". ".join(rng.choice(PHRASES) + " " + " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 7)))
        table = "".join(f"| {rng.choice(['Term loan', 'Total debt', 'Revolving credit facility', 'Assets', 'Long-term debt, net'])} | {rng.randrange(999)} |\n" for _ in range(rng.choice([0, 0, 1, 3])))
        parts.append(f"Note {i + 1} {rng.choice(['-', '—', ''])} {rng.choice(HEADINGS)}\n{body}\n{table}{'tiny' if rng.random() < 0.2 else ''}\n")
        bodies.append(body)
    text = "".join(parts)
    cut = lambda: (lambda b: b[(a := rng.randrange(max(1, len(b) - 60))) : a + rng.choice([50, 90, 300])])(rng.choice(bodies)) if bodies else "x"
    blocks = [(cut() + rng.choice(["", " changed in the end of it all", ""]), rng.random() < 0.5) for _ in range(rng.randrange(4))]
    reports = [cut() for _ in range(rng.randrange(2))]
    patterns = [(rng.choice(HEADINGS), str(rng.randrange(1, 9)), rng.sample(["credit agreement", "collateral", "term"], 2)) for _ in range(rng.randrange(3))]
    return text, blocks, reports, rng.sample(fo.SHEET_LABELS, rng.randrange(4)), patterns, rng.random() < 0.7


def test_driver_against_a_plain_pass(spark):
    rng = random.Random(8)
    filings = [made(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(filings)] + [(900, None)], "key long, text string").withColumn("body_", F.lit("clash"))
    blocks = spark.createDataFrame([(i, j, t, d) for i, f in enumerate(filings) for j, (t, d) in enumerate(f[1])], "key long, block int, text string, disclosure boolean")
    reports = spark.createDataFrame([(i, j, t) for i, f in enumerate(filings) for j, t in enumerate(f[2])], "key long, report int, text string")
    sheets = spark.createDataFrame([(i, f[3]) for i, f in enumerate(filings)], "key long, labels array<string>")
    priors = spark.createDataFrame([(i, f[4]) for i, f in enumerate(filings)], "key long, patterns array<struct<heading:string,number:string,labels:array<string>>>")
    found = spark.createDataFrame([(i,) for i, f in enumerate(filings) if f[5]], "key long")
    out = fo.debt_footnotes(fo.filing_notes(df), blocks, reports, sheets, priors, found)
    got = {r.key: (r.note, r.start, r.end, round(r.total, 4), r.confidence, r.method, r.paths, r.n_candidates, r.runner_up and round(r.runner_up, 4)) for r in out.collect()}
    want = {i: b for i, f in enumerate(filings) if (b := brute_filing(*f)) is not None}
    assert {k: (v[3], v[8]) for k, v in got.items()} == {k: (v[3], v[8]) for k, v in want.items()}
    assert got == want
    assert len({v[4] for v in got.values()}) == 4 and len({v[5] for v in got.values()}) >= 4
    alone = fo.debt_footnotes(fo.filing_notes(df))
    assert {r.key: round(r.total, 4) for r in alone.collect()} == {i: b[3] for i, f in enumerate(filings) if (b := brute_filing(f[0], [], [], [], [], True)) is not None}


def test_notes_within_bounds(spark):
    text = "Note 1 - Before\nx\nNote 2 - Debt\nbody | no table\n| a | b |\n| c | d |\n\nNote 2A: More\n"
    df = spark.createDataFrame([(1, text), (2, text)], "key long, text string")
    bounds = spark.createDataFrame([(1, 16, 45)], "key long, start long, end long")
    rows = fo.filing_notes(df, bounds=bounds).orderBy("key", "start").collect()
    assert [(r.key, r.note, r.heading) for r in rows] == [(1, "2", "Note 2 - Debt"), (2, "1", "Note 1 - Before"), (2, "2", "Note 2 - Debt"), (2, "2A", "Note 2A: More")]
    assert text[rows[0].start : rows[0].end] == rows[0].body == "Note 2 - Debt\nbody | no tab" and rows[2].tables == ["| a | b |\n| c | d |\n"]


def test_balance_sheet_labels(spark):
    df = spark.createDataFrame([("long-term debt, net",), ("operating lease liabilities",), ("notes payable and operating lease liabilities",), ("",)], "t string")
    assert [list(r[0]) for r in df.select(fo.sheet_labels(F.col("t"))).collect()] == [["long-term debt", "long-term debt, net", "debt, net"], ["operating lease liabilities"], ["notes payable"], []]


def test_chains_with_tails_and_cycles_only(spark):
    rng = random.Random(3)
    heads, links = [], []
    for k in range(16):
        n = rng.randrange(1, 50)
        ids = [f"c{i:02}" for i in range(n)]
        links += [(k, i, rng.choice(ids)) for i in ids] if k % 2 else [(k, ids[i], ids[i + 1] if i < n - 1 else ids[max(0, n - 3)]) for i in range(n)]
        heads += [(k, h, rng.choice(ids)) for h in range(5)]
    path = fo.follow_chains(spark.createDataFrame(heads, "key long, head int, next string"), spark.createDataFrame(links, "key long, id string, next string"), "key")
    got = {}
    for r in sorted(path.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.key, r.head), []).append(r.id)
    assert got == {(k, h): brute_chain(n, {i: t for kk, i, t in links if kk == k}) for k, h, n in heads}
