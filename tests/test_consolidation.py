"""Printed statements against facts: damaged tables come back whole, and every fact's check equals a plain pass."""

import datetime
import random
import re

from pyspark.sql import functions as F

from tallyframe.operators import consolidation as co

FACTS = "key long, kind string, concept string, line string, period string, value double, pos int"
PERIODS = [("2017-01-01 to 2017-12-31", ["FY2017", "fy '17", "FY17E", "2017-01-01 TO 2017-12-31", "Q4 2017", "year to 2017-12-31"]), ("2017-07-01 → 2017-09-30", ["Q3 2017", "3Q17", "3q '17", "2017-09-30 (3m)"]), ("2018-12-31", ["2018-12-31", "FY18", "4Q 2018"]), ("2018-06-30", ["Q2 18", "as of 2018-06-30"]), ("TTM", ["ttm", " TTM "])]
WRONG = ["FY2016", "Q1 2017", "FY2018X", "", "2017", "Q5 2017"]


def plain_compatible(a, b):
    a, b = a.strip(), b.strip()
    if not a or not b:
        return False
    if a.lower() == b.lower():
        return True
    b = b.lower()
    m = re.search(r"(\d{4}-\d{2}-\d{2})\s*(?:to|→|->)\s*(\d{4}-\d{2}-\d{2})", a, re.I)
    end = m[2] if m else a if re.fullmatch(r"\d{4}-\d{2}-\d{2}", a) else None
    if end is None:
        return False
    day = datetime.date.fromisoformat
    full = lambda y: int(y) + 2000 if int(y) < 100 else int(y)
    if (y := re.search(r"\bfy\s*'?(\d{2}|\d{4})(?:\s*e)?\b", b)) and full(y[1]) == int(end[:4]) and ((day(end) - day(m[1])).days >= 330 if m else end.endswith("-12-31")):
        return True
    if q := re.search(r"\b(?:q([1-4])|([1-4])q)\s*'?(\d{2}|\d{4})\b", b):
        if f"{full(q[3])}-{['03-31', '06-30', '09-30', '12-31'][int(q[1] or q[2]) - 1]}" == end:
            return True
    return end in b


def test_periods(spark):
    pairs = [(p, h) for p, _ in [*PERIODS, ("", []), (None, []), ("2017-01-01 to 2017-06-30", [])] for h in [x for _, hs in PERIODS for x in hs] + WRONG + ["x12018-12-31", None]]
    df = spark.createDataFrame(pairs, "p string, h string")
    got = [r[0] for r in df.select(F.arrays_overlap(co.fact_period_names(F.col("p")), co.header_period_names(F.col("h")))).collect()]
    assert [bool(g) for g in got] == [plain_compatible(p or "", h or "") for p, h in pairs]
    assert all(plain_compatible(p, h) for p, hs in PERIODS for h in hs)


def test_numbers(spark):
    cases = [("(1,234.5)", -1234.5), ("$ 1 234", 1234.0), ("—", None), ("n/a", None), ("NM", None), ("12%", 0.12), ("(12%)", -0.12), ("1.5m", 1.5e6), ("2B", 2e9), ("", None), (None, None), ("abc", None), ("-3", -3.0), ("7x", 7.0)]
    df = spark.createDataFrame(cases, "c string, v double")
    assert [r[0] for r in df.select(co.printed_number(F.col("c"))).collect()] == [v for _, v in cases]
    money = spark.createDataFrame([(1234.5,), (-0.5,), (0.0,), (1e9,)], "v double")
    assert [r[0] for r in money.select(co.printed_money(F.col("v"))).collect()] == ["1,234.50", "(0.50)", "0.00", "1,000,000,000.00"]


def money(v):
    return f"({abs(v):,.2f})" if v < 0 else f"{v:,.2f}"


TITLES = {"is": "## Income statement", "bs": "# **Balance** sheet", "cf": "### Cash flows"}


def make(rng, key):
    """A document's facts, its text as it should be, and the text with damaged numbers."""
    facts, whole, hurt, pos = [], ["intro | not a table"], ["intro | not a table"], 0
    for kind in rng.sample(["is", "bs", "cf"], rng.randrange(0, 4)):
        periods = rng.sample(PERIODS, rng.randrange(1, 4))
        head = ["Line item", "Concept", *(rng.choice(hs).strip() for _, hs in periods), rng.choice(["Other", "Notes"])]
        good, bad = [head], [head]
        for i in range(rng.randrange(1, 5)):
            concept, line = rng.choice([f"us:C{i}", f"us:C{i}", "plain"]), f"Item {kind} {i}."
            a, b = [f"**{line}**", concept], [f"**{line}**", concept]
            for period, _ in periods:
                v = round(rng.uniform(-1e6, 1e6), 2)
                there = rng.random() < 0.8
                if there:
                    facts.append((key, kind, concept, line, period, v, pos))
                    pos += 1
                right = there and ":" in concept
                a.append(money(v) if right else "as is")
                b.append(rng.choice(["0", money(v + 1), "x", ""]) if right and rng.random() < 0.5 else a[-1])
            good.append(a + ["-"])
            bad.append(b + ["-"])
        bar = lambda r: "| " + " | ".join(r) + " |"
        for lines, rows in ((whole, good), (hurt, bad)):
            lines += [TITLES[kind], "", bar(rows[0]), "| " + " | ".join(["---"] * len(head)) + " |", *map(bar, rows[1:]), "after"]
    extra = ["#### deep heading", "## Other", "| a | b |", "|:--|", "| c |"]
    return facts, "\n".join(whole + extra), "\n".join(hurt + extra)


def test_damaged_tables_come_back_whole(spark):
    rng = random.Random(6)
    made = [make(rng, k) for k in range(80)]
    facts = spark.createDataFrame([f for m in made for f in m[0]], FACTS)
    docs = spark.createDataFrame([(k, m[2]) for k, m in enumerate(made)] + [(900, None), (901, "| x |")], "key long, text string").withColumn("line", F.lit("clash"))
    got = {r.key: r.text for r in co.repair_statements(docs, facts).collect()}
    assert got == {k: m[1] for k, m in enumerate(made)} | {900: "", 901: "| x |"}
    assert sum(m[1] != m[2] for m in made) > 30


def brute_check(text, facts):
    grids, kind, block = {}, None, []
    for s in [*text.split("\n"), ""]:
        if s.strip().startswith("|"):
            cells = [c.strip() for c in s.strip().strip("|").split("|")]
            if not all(re.fullmatch(":?-{2,}:?", c) for c in cells):
                block.append(cells)
            continue
        if block and kind:
            grids[kind] = block
        block = []
        if m := re.match(r"#{1,3}\s+(.+)", s):
            t = re.sub("[#*`]", "", m[1]).lower()
            kind = "cf" if "cash flow" in t else "bs" if "balance" in t else "is" if "income" in t else None
    lab = lambda x: re.sub(r"\s+", " ", re.sub("[.,;:]", " ", x.replace("**", "").lower())).strip()
    out = {}
    for _, k, concept, line, period, value, pos in facts:
        grid = grids.get(k)
        names = {lab(f[3]) for f in facts if f[1] == k and f[2] == concept}
        if not grid or len(grid) < 2:
            out[pos] = "no table"
            continue
        col = next((c for c in range(1, len(grid[0])) if plain_compatible(period, grid[0][c])), None)
        row = next((r for r in grid[1:] if lab(r[0]) and any(n in lab(r[0]) or lab(r[0]) in n for n in names)), None)
        if col is None or row is None:
            out[pos] = "no period" if col is None else "no line"
            continue
        cell = row[col]
        m = re.fullmatch(r"(\()?([\d,]+(?:\.\d+)?)\)?", cell)
        number = float(m[2].replace(",", "")) * (-1 if m[1] else 1) if m else None
        out[pos] = "no number" if number is None else "right" if abs(number - value) <= 0.02 else "wrong"
    return out


def test_checks_against_a_plain_pass(spark):
    rng = random.Random(7)
    made = [make(rng, k) for k in range(80)]
    for m in made:  # facts that the text doesn't have
        for i in range(rng.randrange(3)):
            m[0].append((m[0][0][0] if m[0] else 999, rng.choice(["is", "bs", "cf"]), "us:New", rng.choice(["New line", "Item"]), rng.choice(PERIODS)[0], 5.0, 1000 + i))
    rows = [f for m in made for f in m[0] if f[0] != 999]
    docs = spark.createDataFrame([(k, m[2]) for k, m in enumerate(made)], "key long, text string")
    facts = spark.createDataFrame(rows, FACTS)
    got = {(r.key, r.pos): r.status for r in co.check_statements(docs, facts).collect()}
    want = {(k, p): s for k, m in enumerate(made) for p, s in brute_check(m[2], [f for f in rows if f[0] == k]).items()}
    assert got == want and set(got.values()) == {"no table", "no period", "no line", "no number", "right", "wrong"}
    missing = {(r.key, r.kind, r.concept) for r in co.missing_concepts(docs, facts).collect()}
    assert {(k, p) for k, p in got if got[k, p] in ("no table", "no line")} <= {(f[0], f[6]) for f in rows if (f[0], f[1], f[2]) in missing}


def test_hints(spark):
    text = "# Income\n| Line | FY2017 |\n|--|--|\n| a | (5.00) |\n| b | 12 |\n| c | 3 |\n| d | 9 |"
    rows = [(1, "is", c, c, "2017-01-01 to 2017-12-31", v, i) for i, (c, v) in enumerate([("a", 5.0), ("b", 12_345.0), ("c", 3_100_000.0), ("d", 1.0)])]
    out = co.check_statements(spark.createDataFrame([(1, text)], "key long, text string"), spark.createDataFrame(rows, FACTS))
    assert [r.hint for r in out.orderBy("pos").collect()] == ["sign", "thousands", "millions", None]
