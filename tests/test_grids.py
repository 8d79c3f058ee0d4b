"""Merged tables and resolved columns against sequential versions on made tables."""

import random
import re

from pyspark.sql import functions as F

from tallyframe.operators import grids as gr

NAMES = ["Acme LLC", "Beta Inc.", "Gamma (Delaware)", "Delta GmbH (50%)", "", "x", "Nevada", "DE", "12%", "plain words", "List of subsidiaries"]
HEADERS = [["Name of subsidiary", "Jurisdiction"], ["Legal name", "Domicile", "Interest"], ["Company", "x"], ["", "State of incorporation", ""]]


def header(row):
    j = re.sub(r"\(\s*\d{1,3}(?:\.\d+)?\s*%\s*\)", " ", " | ".join(row))
    return bool(re.search(gr.HEADER, j, re.I))


def boost(rows):
    text, line = "\n".join(" ".join(r) for r in rows).lower(), re.sub(r"\s+", "", "".join("".join(r) for r in rows))
    n, shares = text.count("("), len(re.findall(r"\(\s*\d{1,3}(?:\.\d+)?\s*%\)", text))
    out = 400 * bool(re.search(r"\blist\s+of\s+subsidiaries\b", text)) + (min(n * 14, 320) if n >= 2 else 0) + (min(shares * 22, 220) if shares >= 2 else 0)
    out += 120 * bool(re.search(gr.scores.TABLE_SUFFIXES, text, re.I))
    return out - 900 * bool(len(line) < 180 and re.search(r"\.html?$", line, re.I))


def score(rows):
    return len(rows) * max(map(len, rows)) * 8 + sum(len(c.strip()) > 1 for r in rows for c in r) + boost(rows)


def pad(rows):
    w = max(map(len, rows))
    return [r + [""] * (w - len(r)) for r in rows]


def brute_merge(tables):
    """Every chain from every table and every width, rows and all."""
    tables = [[r for r in t if any(c.strip() for c in r)] for t in tables]
    usable = [pad(t) for t in tables if len(t) >= 2 and max(map(len, t)) >= 2]
    options = [(score(t), 1, -i, t) for i, t in enumerate(usable)]
    later = lambda t: t[1:] if header(t[0]) else t
    for s, t in enumerate(usable):
        if len(usable) < 2 or boost(t) < -800:
            continue
        acc = t
        for n in usable[s + 1 :]:
            if abs(max(map(len, acc)) - max(map(len, n))) > 2 or boost(n) < -700 or not later(n):
                break
            acc = acc + later(n)
        options.append((score(acc), 3, -s, acc))
    for w in {max(map(len, t)) for t in usable}:
        same = [i for i, t in enumerate(usable) if max(map(len, t)) == w]
        if len(same) > 1:
            acc = usable[same[0]] + [r for i in same[1:] for r in later(usable[i])]
            options.append((score(acc), 2, -same[0], acc))
    return pad(max(options, key=lambda o: o[:3])[3]) if options else None


def made(rng):
    out = []
    for _ in range(rng.randrange(0, 6)):
        w = rng.choice([1, 2, 2, 3, 3, 4, 6, 7])
        rows = [[rng.choice(NAMES) for _ in range(rng.choice([w, w, max(1, w - 1)]))] for _ in range(rng.randrange(0, 5))]
        out.append(([rng.choice(HEADERS)] if rng.random() < 0.4 else []) + rows if rng.random() < 0.9 else [["a", "b.htm"]] * rng.randrange(1, 3))
    return out


def test_merged_tables_against_a_sequential_version(spark):
    rng = random.Random(3)
    docs = [made(rng) for _ in range(200)]
    rows = [(k, i, t) for k, d in enumerate(docs) for i, t in enumerate(d)] + [(900, 0, None), (901, 0, [[None, "x"], ["y", None]])]
    df = spark.createDataFrame(rows, "key long, number int, rows array<array<string>>").withColumn("width", F.lit("clash"))
    got = {}
    for r in gr.merge_tables(df).orderBy("key", "row").collect():
        got.setdefault(r.key, []).append(list(r.cells))
    want = {k: m for k, d in enumerate(docs) if (m := brute_merge(d)) is not None} | {901: [["", "x"], ["y", ""]]}
    assert got == want and len(got) > 100


def brute_columns(rows):
    w = max(map(len, rows), default=0)
    rows = [r + [""] * (w - len(r)) for r in rows]
    sp = lambda c: re.sub(r"\s+", " ", c).strip()
    has = lambda p, c: bool(re.search(p, c, re.I))
    plausible = lambda c: 3 <= len(t := sp(c)) <= 240 and not has(r"^of\s+incorporation|^state\s+or\s+country", t) and not re.match(r"(\d{1,4}%?|\d+)$", t) and has("[a-zÀ-ÖØ-öø-ÿ]", t)
    region = lambda c: 2 <= len(t := re.sub(r"\.$", "", sp(c))) <= 40 and (bool(re.match("[A-Za-z]{2}$", t)) or has(gr.REGIONS, t))
    if not rows:
        return []
    headed = len(rows) >= 2 and header(rows[0])
    head, body = (rows[0], rows[1:]) if headed else ([], rows)
    index = lambda p: next((i for i, c in enumerate(head) if has(p, c.strip())), -1)
    better = lambda p: next((i for i, c in enumerate(head) if c.strip() and not has(r"^column\s*\d+", c.strip()) and has(p, c.strip())), index(p))
    if headed:
        entity, dom = max(0, better(gr.ENTITY)), better(gr.DOMICILE)
        if dom < 0 and len(head) >= entity + 2 and not has(gr.NAMING, head[entity + 1].strip()):
            dom = entity + 1
        for i, r in enumerate(body):
            if dom >= 0 and not r[entity].strip() and plausible(r[dom]) and dom + 1 < len(r) and region(r[dom + 1]):
                fixed = list(r)
                fixed[entity], fixed[dom] = r[dom].strip(), r[dom + 1].strip()
                rest = [sp(c) for c in r[dom + 2 :]]
                fixed[dom + 1 :] = rest + [""] * (len(r) - dom - 1 - len(rest))
                body[i] = fixed
    name_at = max(0, index(gr.ENTITY))
    jur = index(gr.DOMICILE)
    if jur < 0 and name_at + 1 < len(head) and not has(gr.NAMING_WHOLE, head[name_at + 1].strip()):
        jur = name_at + 1
    out, seen = [], set()
    for i, r in enumerate(body):
        fits = [c.strip() for c in [r[name_at], *r[:name_at], *r[name_at + 1 :]] if plausible(c) and not (region(c) and len(c.strip()) <= 14 and not re.search("[,.]", c) and not has(gr.SUFFIX, c))]
        if not fits or fits[0].lower() in seen:
            continue
        seen.add(fits[0].lower())
        place = sp(r[jur]) if 0 <= jur < len(r) else ""
        place = place or next((sp(c) for j, c in enumerate(r) if j != name_at and sp(c) != fits[0] and region(c)), "")
        out.append((i, sp(fits[0]), place))
    return out


def test_columns_against_a_sequential_version(spark):
    rng = random.Random(4)
    tables = []
    for _ in range(300):
        w = rng.randrange(1, 6)
        head = [rng.choice(["Entity Name", "Domicile", "Jurisdiction of incorporation", "column 2", "column 3 subsidiary", "Ownership", "", "Name of owner", "Subsidiaries"]) for _ in range(w)]
        rows = [[rng.choice(["", "", "Acme LLC", "ACME LLC", "Beta  Holdings", "DE", "Nevada", "new york", "Texas, Inc.", "12", "50%", "of incorporation", "é", "Delaware."]) for _ in range(rng.choice([w, w, max(1, w - 1), w + 1]))] for _ in range(rng.randrange(0, 7))]
        tables.append(([head] if rng.random() < 0.8 else []) + rows)
    df = spark.createDataFrame([(k % 7, k, t) for k, t in enumerate(tables)] + [(1, 999, None)], "key long, number int, rows array<array<string>>").withColumn("name", F.lit("clash"))
    got = {}
    for r in gr.subsidiary_rows(df).orderBy("number", "row").collect():
        got.setdefault(r.number, []).append((r.row, r.name, r.jurisdiction))
    assert got == {k: b for k, t in enumerate(tables) if (b := brute_columns([list(r) for r in t]))}
    assert len(got) > 150


def test_shifted_row(spark):
    rows = [["Entity Name", "Domicile", "Ownership", ""], ["A One LLC", "Delaware", "100%", ""], ["", "B Two Inc.", "NV", "50%"]]
    df = spark.createDataFrame([(1, 0, rows)], "key int, number int, rows array<array<string>>")
    assert [tuple(r)[2:] for r in gr.subsidiary_rows(df).orderBy("row").collect()] == [(0, "A One LLC", "Delaware"), (1, "B Two Inc.", "NV")]
