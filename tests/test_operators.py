"""Small cases of the corpus, search, entity, filing and application operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyframe.functions import keep, periods, text as tx
from tallyframe.operators import application as app
from tallyframe.operators import corpus, entities, filings, research, search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_text(spark):
    c = F.col("t")
    assert one(spark, tx.local_name(c), t="http://fasb.org/us-gaap/2024/Revenue") == "Revenue"
    assert one(spark, tx.local_name(c), t="us-gaap:Assets") == "Assets"
    assert one(spark, tx.statement_label(c), t="Total Current Liabilities (Note 3) & Securities:") == "current liability and security"
    assert one(spark, tx.entity_root(c), t="Acme Foods Holdings, Inc.") == "ACME FOODS"
    assert one(spark, tx.match_url(c), t="HTTPS://News.Example.com/a/b/?utm_source=x&id=3#top") == "https://news.example.com/a/b?id=3"
    assert one(spark, tx.match_url(c), t="no url") is None
    assert one(spark, tx.financial_number(c), t="(1,234)") == -1234.0
    assert one(spark, tx.financial_number(c), t="12.5%") == 0.125
    assert one(spark, tx.financial_number(c), t="—") is None
    assert one(spark, tx.html_to_text(c), t="<p>a &amp; b</p><script>x</script><br>c") == "a & b c"
    assert one(spark, tx.summary(c), t="First one here. Second.") == "First one here."
    assert abs(one(spark, tx.jaccard(tx.word_set(F.col("a")), tx.word_set(F.col("b"))), a="a bb cc", b="bb cc dd") - 2 / 3) < 1e-9
    assert one(spark, tx.dice(F.col("a"), F.col("b")), a="night", b="nacht") == 0.25
    assert one(spark, corpus.dedupe_paragraphs(c), t="A\n\nb\n\na") == "A\n\nb"
    assert one(spark, tx.hash31(c), t="ab") == 97 * 31 + 98


def test_periods(spark):
    labels = ["FY15", "2Q15", "1Q15", "4Q15", "3Q15", "x", "6M15"]
    df = spark.createDataFrame([(x,) for x in labels], "p string").withColumn("k", periods.sort_key(F.col("p")))
    assert [r.p for r in df.orderBy("k").collect()] == ["1Q15", "2Q15", "3Q15", "4Q15", "FY15", "6M15", "x"]
    day = spark.sql("SELECT date'2020-06-30' AS d, date'2020-04-01' AS s")
    assert day.select(periods.minus_months(F.col("d"), 3)).first()[0] == dt.date(2020, 3, 31)
    assert day.select(periods.fiscal_label(F.col("s"), F.col("d"), 12, 31)).first()[0] == "2Q20"
    assert day.select(periods.fiscal_label(F.col("s"), F.col("d"), 6, 30)).first()[0] == "4Q20"
    assert [r[0] for r in spark.sql("SELECT explode(array(-1.5, 1.5, 2.4)) AS x").select(keep.js_round(F.col("x").cast("double"))).collect()] == [-1, 2, 2]


def test_greedy_clusters_against_brute_force(spark):
    """Heads in order of priority, newest first; duplicates by URL at any time, by title within two hours."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "rises", "falls", "today", "again"]
    rows = []
    for i in range(160):
        title = " ".join(rng.sample(words, rng.randrange(4, 7)))
        url = rng.choice([None, "", f"https://a.com/{rng.randrange(60)}", f"HTTPS://A.com/{rng.randrange(60)}/?utm_source=x", f"https://b.com/{i}"])
        rows.append((i, rng.choice([title, "the same title of all"]), url, rng.choice([None, 1_700_000_000 + rng.randrange(40_000)]), rng.randrange(3)))
    df = spark.createDataFrame(rows, "id long, title string, url string, t long, priority int").withColumn("at", F.timestamp_seconds("t"))
    df = df.withColumn("words", tx.word_set(F.col("title")))
    got = {r.id: r.cluster for r in search.greedy_clusters(df, "id", "url", "words", "at", [F.col("priority"), -F.coalesce("t", F.lit(0))]).collect()}
    link = lambda u: u.lower().split("?")[0].rstrip("/") if u else None
    heads, want = [], {}
    for i, title, url, t, p in sorted(rows, key=lambda r: (r[4], -(r[3] or 0), r[0])):
        w = set(title.split())
        dup = next((h for h in heads if (link(url) and link(url) == link(h[2])) or (t and h[3] and abs(t - h[3]) <= 7200 and len(w & set(h[1].split())) >= 0.82 * len(w | set(h[1].split())))), None)
        if dup is None:
            heads.append((i, title, url, t, p))
        want[i] = dup[0] if dup else i
    assert got == want
    assert search.greedy_clusters(df.limit(0), "id", "url", "words", "at", [F.col("priority")]).count() == 0


def test_pairwise_mean(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, i, f"t{'x' * i}", "https://e.com/abcdef", "s", "p", v, at, 1) for i, v in enumerate((0.2, 0.4, 0.8))]
    df = spark.createDataFrame(rows, "c int, i int, title string, url string, summary string, provider string, score double, at timestamp, priority int")
    r = search.merge_clusters(df, "c", ["i"]).first()
    assert abs(r.score - 0.55) < 1e-12 and r.title == "txx" and r.n == 3


def test_budget_pack_stops(spark):
    df = spark.createDataFrame([(1, 3.0, 100), (2, 2.0, 100), (3, 1.0, 50)], "k int, s double, n int")
    assert [r.k for r in corpus.pack_budget(df, "s", "k", "n", 345).collect()] == [1]
    assert [r.k for r in corpus.pack_budget(df, "s", "k", "n", 50).collect()] == [1]


def test_repeated_lines(spark):
    long = "x" * 45
    df = spark.createDataFrame([(1, "\n".join([long, "a", long, "a", long])), (2, None)], "k int, t string")
    out = {r.k: (r.t, r.n_dropped) for r in corpus.drop_repeated_lines(df, "k", "t", 40, 3).collect()}
    assert out == {1: (f"{long}\na\na", 2), 2: ("", 0)}


def test_keyword_windows(spark):
    t = "a" * 500 + "debt" + "b" * 10 + "debt" + "c" * 900 + "debt"
    out = corpus.keyword_windows(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", "debt").orderBy("nth").collect()
    assert [r["at"] for r in out] == [500, 1418] and out[0].snippet == t[280:820]


def test_next_fit_and_upsert(spark):
    df = spark.createDataFrame([("o", i, s) for i, s in enumerate((40, 50, 20, 500, 10))], "o string, i int, size long")
    assert [r.part for r in app.next_fit(df, "o", "i", "size", 100).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("a", 3, "w"), ("c", 1, "n")], "k string, seq int, v string")
    assert {r.k: r.v for r in app.upsert(old, new, ["k"], "seq").collect()} == {"a": "w", "b": "y", "c": "n"}


def test_filings(spark):
    f = spark.createDataFrame([("k", "NetIncomeLoss", v, "USD", 0) for v in (1.0, 2.0, 3.0, 4.0)] + [("k", "NetIncomeLoss", 99.0, "EUR", 0)], "k string, c string, v double, u string, d int")
    assert filings.resolve_duplicates(f, ["k"], "c", "v", "u", "d").first().v == 3.0
    arcs = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0)], "parent string, child string, weight double")
    values = spark.createDataFrame([("t1", "p", 3.0), ("t1", "a", 1.0), ("t1", "b", 2.0), ("t2", "p", 3.0), ("t2", "a", 1.0), ("t2", "b", None)], "t string, concept string, value double")
    assert [(r.t, r.passed) for r in filings.rollups(arcs, values, ["t"], 0.1).collect()] == [("t1", True)]
    notes = spark.createDataFrame([("n", "Senior secured notes 2030", "$1,250 million", "2030-06-01"), ("m", "zzzz", None, None)], "note string, description string, amount string, maturity string")
    inst = spark.createDataFrame([(0, "Term loan", "100", "2027"), (1, "Senior unsecured notes", "1250", "2030")], "pos int, name string, principal string, due string")
    out = {r.note: (r.pos, r.status) for r in filings.reconcile_footnotes(notes, inst).collect()}
    assert out == {"n": (1, "match"), "m": (None, "none")}
    tree = filings.tree_rows(spark.createDataFrame([("r", "a", "b", 2.0), ("r", "a", "c", 1.0), ("r", "c", "a", 1.0)], "role string, parent string, child string, ord double"), spark.createDataFrame([("r", "a")], "role string, node string"))
    assert [r.node for r in tree.where("depth < 2").orderBy("path").collect()] == ["a", "c", "b"]


def test_universe(spark):
    u = spark.createDataFrame([("a", 10.0, ["x"], True), ("b", 10.0, ["x"], False)], "k string, score double, categories array<string>, confirmed boolean")
    m = spark.createDataFrame([("a", 50.0, ["y"]), ("b", 50.0, ["y"]), ("c", 5.0, ["z"])], "k string, score double, categories array<string>")
    out = {r.k: (r.score, r.action) for r in entities.merge_universe(u, m, "k").collect()}
    assert out == {"a": (10.0, "skipped"), "b": (50.0, "updated"), "c": (5.0, "created")}


def test_all_sources_without_a_state_are_recommended(spark):
    sources = [(i, None, 1) for i in range(1200)] + [(1200, "x", 2), (1201, "y", 3), (1202, "x", 4)]
    profiles = [(1, ["x", "x"]), (2, ["y", None]), (3, []), (4, None)]
    df = spark.createDataFrame(profiles, "k int, states array<string>"), spark.createDataFrame(sources, "source int, state string, priority int")
    got = {(r.k, r.source, r.priority) for r in research.recommend_sources(*df, "k").collect()}
    assert got == {(k, s, p) for k, states in profiles for s, state, p in sources if state is None or state in (states or [])}


def test_footnotes_against_all_pairs(spark):
    """Amounts and maturities count without a common word, and principals of fewer than four digits too."""
    names, amounts, dates = ["Senior notes", "Term loan", "zzzz", "", None], ["500", "1,250", "7", "12505000", None], ["2030-06-01", "2027", "", None]
    notes = [(i * 10 + j, names[i % 5], amounts[j % 5], dates[(i + j) % 4]) for i in range(5) for j in range(5)]
    inst = [(0, "Revolver", "500", "2031"), (1, "Debenture", "1250", "2030"), (2, "Senior bond", "99", "2027"), (3, "Facility", "50007", None), (4, "Debenture", "500", "2030"), (5, "Term loan", None, "2030-06"), (6, "None of these", "n/a", "")]
    words = lambda t: {w for w in (t or "").lower().split() if len(w) > 3}
    digits = lambda t: "".join(c for c in t or "" if c.isdigit())
    want = {}
    for k, d, a, m in notes:
        best = (0.0, 0)
        for pos, name, p, due in inst:
            x, y, ia, im = words(d), words(name), digits(p)[:4], (due or "")[:4]
            s = len(x & y) / min(len(x), len(y)) if x and y else 0.0
            s = min(1.0, s + (0.25 if ia and ia in digits(a) else 0) + (0.2 if im and im in (m or "") else 0))
            best = max(best, (s, -pos)) if s else best
        want[k] = (-best[1] if best[0] >= 0.25 else None, round(best[0], 9), "none" if best[0] < 0.25 else "weak" if best[0] < 0.45 else "match")
    n = spark.createDataFrame(notes, "note int, description string, amount string, maturity string")
    i = spark.createDataFrame(inst, "pos int, name string, principal string, due string")
    got = {r.note: (r.pos, round(r.score, 9), r.status) for r in filings.reconcile_footnotes(n, i).collect()}
    assert got == want
    assert {"match", "weak", "none"} == {x[2] for x in want.values()}


def test_greedy_clusters_along_a_chain(spark, monkeypatch):
    """A chain of titles an hour and a half apart: its heads depend on each other, and rounds stay few; rounds alone, the
    bounded last task and brokers give the same."""
    rows = [(i, "https://a.com/%d" % (i % 7) if i % 3 else None, "one title of all", 1_700_000_000 - 5400 * (i // 2), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, url string, title string, t long, g string").withColumn("at", F.timestamp_seconds("t")).withColumn("words", tx.word_set(F.col("title")))
    for group in (None, "g"):
        heads, want = [], {}
        for i, url, _, t, g in rows:
            dup = next((h for h in heads if (group is None or g == h[4]) and (url and url == h[1] or abs(t - h[3]) <= 7200)), None)
            if dup is None:
                heads.append((i, url, _, t, g))
            want[i] = dup[0] if dup else i
        written = []
        write = search.Scratch.write
        monkeypatch.setattr(search.Scratch, "write", lambda self, df, step: written.append(step) or write(self, df, step))
        assert {r.id: r.cluster for r in search.greedy_clusters(df, "id", "url", "words", "at", [F.col("id")], group=group).collect()} == want
        assert len(written) < 12
        monkeypatch.setattr(search.Scratch, "write", write)
        monkeypatch.setattr(search, "REST_ROWS", 5)
        assert {r.id: r.cluster for r in search.greedy_clusters(df, "id", "url", "words", "at", [F.col("id")], group=group).collect()} == want
        monkeypatch.setattr(search, "REST_ROWS", 200_000)


def shuffled_records(spark) -> int:
    """Records that all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    it, n = stages.iterator(), 0
    while it.hasNext():
        n += it.next().shuffleWriteRecords()
    return n


def test_footnotes_of_equal_content_are_matched_once(spark):
    """1,500 notes and 1,500 instruments share a word: 2.25 million pairs of rows, but few of distinct contents."""
    kinds = ["alpha notes", "alpha bonds", "alpha loans due", "gamma"]
    notes = spark.range(1500).selectExpr("id note", f"element_at(array{tuple(kinds)}, cast(id % 4 + 1 as int)) description", "cast(1000 + id % 6 as string) amount", "'2030-01-01' maturity")
    inst = spark.range(1500).selectExpr("id pos", f"element_at(array{tuple(kinds[::-1])}, cast(id % 4 + 1 as int)) name", "cast(1000 + id % 7 as string) principal", "cast(2028 + id % 3 as string) due")
    before = shuffled_records(spark)
    got = {r.note: (r.pos, round(r.score, 9), r.status) for r in filings.reconcile_footnotes(notes, inst).collect()}
    assert shuffled_records(spark) - before < 100_000
    told = [(r.pos, {w for w in r.name.split() if len(w) > 3}, r.principal[:4], r.due[:4]) for r in inst.collect()]
    want = {}
    for r in notes.limit(40).collect():
        w = {x for x in r.description.split() if len(x) > 3}
        s, p = max((min(1.0, len(w & iw) / min(len(w), len(iw)) + 0.25 * (ia in r.amount) + 0.2 * (im in r.maturity)), -pos) for pos, iw, ia, im in told)
        want[r.note] = (-p, round(s, 9), "match" if s >= 0.45 else "weak" if s >= 0.25 else "none")
    assert {k: got[k] for k in want} == want


def test_windows_of_a_text_with_very_many_matches(spark):
    """Time grows with the text's length, not with its matches times that."""
    began = dt.datetime.now()
    df = spark.createDataFrame([(1, "the " * 30_000), (2, "no match"), (3, None), (4, "xthe the " + "y" * 500 + "the")], "k int, t string")
    got = [(r.k, r.nth, r["at"]) for r in corpus.keyword_windows(df, "k", "t", "the").orderBy("k", "nth").collect()]
    assert got == [(1, i, 400 * i) for i in range(18)] + [(4, 0, 1), (4, 1, 509)]
    assert (dt.datetime.now() - began).total_seconds() < 60
