"""Queries of scores and rule tables over whole columns of text, against SQL that says the points by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import classes, relevance, rules, scores
from tallyframe.functions import text as tx
from tallyframe.operators import environment, research
from tallyframe.plans.queries import query, table

_NORMAL = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TITLED = f"""WITH d AS (SELECT doc_id, substring(text, 1, 40 - 30 * (doc_id % 7 = 0)::INT) AS title, substring(text, 41, 200) AS rest, source, lang, n_chars, (doc_id * 37 % 400)::DOUBLE AS days FROM documents),
t AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(rest, '')) AS blob, length({_NORMAL.format('title')}) AS n_title FROM d)"""


def _titled(spark, sf_dir):
    """Documents as found items: the beginning as title (every seventh a short one), what follows as snippet."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    title = F.when(k % 7 == 0, F.substring("text", 1, 10)).otherwise(F.substring("text", 1, 40))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-06-01 00:00:00")) - (k * 37 % 400) * 86400)
    return d.select("doc_id", title.alias("title"), F.substring("text", 41, 200).alias("rest"), "text", "source", "lang", "n_chars", at.alias("at"))


_AS_OF = "2024-06-01 00:00:00"


@query(_TITLED + """ SELECT doc_id, (CASE WHEN lang = 'en' THEN 35 ELSE 0 END + CASE WHEN contains(blob, 'en') THEN 18 ELSE 0 END + CASE WHEN contains(blob, 'que la') THEN 28 ELSE 0 END + CASE WHEN contains(blob, 'que') THEN 10 ELSE 0 END
 + CASE WHEN contains(blob, 'the') THEN 12 ELSE 0 END + CASE WHEN contains(blob, 'und') THEN 12 ELSE 0 END + CASE WHEN days < 2 THEN 22 WHEN days < 7 THEN 16 WHEN days < 30 THEN 10 WHEN days < 180 THEN 4 ELSE 0 END + least(15, 7 * (doc_id % 4)) + CASE WHEN length(rest) > 80 THEN 6 ELSE 0 END
 + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END + greatest(0, 6 - least(6, CASE WHEN doc_id % 5 = 0 THEN 5 ELSE doc_id % 9 END)) - CASE WHEN n_title < 12 THEN 4 ELSE 0 END)::DOUBLE AS score FROM t""")
def fn_r01_news_points(spark, sf_dir):
    k = F.col("doc_id")
    flag = lambda n: F.when(k % n == 0, F.lit("x"))
    s = relevance.news_points(F.col("title"), F.col("rest"), F.array("lang"), k % 4, F.col("at"), "EN", "que la", F.lit(_AS_OF), F.when(k % 5 != 0, (k % 9).cast("int")), ["the", "und", "zz"], flag(3), flag(2))
    return _titled(spark, sf_dir).select("doc_id", s.alias("score"))


@query("""WITH h AS (SELECT event_id AS id, event_type, user_id, (epoch(TIMESTAMP '2024-02-01') - epoch_us(ts) / 1e6) / 86400 AS a FROM events)
SELECT id, (CASE WHEN event_type = 'click' THEN 35 + 18 ELSE 0 END + CASE WHEN a < 2 THEN 22 WHEN a < 7 THEN 16 WHEN a < 30 THEN 10 WHEN a < 180 THEN 4 ELSE 0 END + 7 + greatest(0, 6 - least(6, user_id % 5)))::DOUBLE AS score FROM h ORDER BY score DESC, a, id LIMIT 100""")
def topk_07_fn_r01_news(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    title = F.concat(F.lit("about "), "event_type", F.lit(" in the news"))
    score = relevance.news_points(title, F.lit("short"), F.array(F.upper("event_type")), F.lit(1), F.col("ts"), "CLICK", "Zzyzx Works", F.lit("2024-02-01"), (F.col("user_id") % 5).cast("int"))
    return e.select(F.col("event_id").alias("id"), score.alias("score"), "ts").orderBy(F.desc("score"), F.desc("ts"), "id").limit(100).select("id", "score")


@query(_TITLED + """ SELECT doc_id, round(CASE WHEN lang = 'en' THEN 40 ELSE 0 END + CASE WHEN contains(blob, 'en') THEN 22 ELSE 0 END + CASE WHEN contains(blob, 'que la') THEN 28 ELSE 0 END + CASE doc_id % 3 WHEN 0 THEN 12 + 4 + 4 WHEN 1 THEN 10 + 6 ELSE 0 END
 + CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN -25 WHEN 2 THEN 14 + 4 ELSE 14 END - CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 35 ELSE 0 END + CASE WHEN days < 30 THEN 18 WHEN days < 90 THEN 12 WHEN days < 365 THEN 6 ELSE 0 END + CASE WHEN length(rest) > 80 THEN 8 ELSE 0 END
 + CASE WHEN n_chars % 10 > 5 THEN 10 ELSE 0 END - CASE WHEN n_title < 14 THEN 6 ELSE 0 END + n_chars * 0.01, 6) AS score FROM t""")
def fn_r02_broker(spark, sf_dir):
    k, lit = F.col("doc_id"), F.lit
    pick = lambda n, *v: F.element_at(F.array(*v), (k % n + 1).cast("int"))
    signals = pick(3, F.array(*map(lit, ["broker_domain_match", "url_hint:a", "url_hint:b"])), F.array(*map(lit, ["company_name_in_text", "ticker_in_text"])), F.array(lit("other")))
    kind = pick(4, *map(lit, ["unknown", "research_landing_page", "research_portal", "note"]))
    url = pick(5, *map(lit, ["https://b.com/Research/", "https://b.com/", "not a url", "https://b.com/research/x", "https://b.com/ideas2?a=/"]))
    s = relevance.report_points(F.col("title"), F.col("rest"), url, F.array("lang"), signals, kind, F.col("at"), "EN", "que la", F.lit(_AS_OF), (F.col("n_chars") % 10) / 10, F.col("n_chars"))
    return _titled(spark, sf_dir).select("doc_id", F.round(s, 6).alias("score"))


_POSTED = """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, substring(text, 1, 30) AS title, row_number() OVER () AS r FROM conversations), t AS (SELECT *, lower(coalesce(title, '')) AS lt, lower(coalesce(title, '')) || chr(10) || lower(text) AS b FROM c)"""


@query(_POSTED + """, s AS (SELECT conv_id, turn, CASE WHEN contains(lt, 'en') THEN 38 WHEN contains(b, 'en') THEN 16 ELSE 0 END + CASE WHEN contains(lt, 'que') THEN 34 WHEN contains(b, 'que') THEN 20 ELSE 0 END + CASE WHEN contains(lt, 'the') OR contains(lt, 'der') THEN 14 ELSE 0 END
 + CASE WHEN regexp_matches(b, '(debt|bond|bankrupt|chapter\\s*11|restruct|distress|covenant|default|maturity|refinanc|credit|high\\s*yield|leveraged|short\\s+thesis|long\\s+thesis|earnings|equity)') THEN 12 ELSE 0 END + CASE WHEN conv_id % 3 = 0 THEN 12 ELSE 0 END
 + least(22, 4 * ln(1 + conv_id % 1000)) + least(18, 3 * ln(1 + turn)) + CASE WHEN conv_id % 4 >= 2 THEN 10 ELSE 0 END - CASE WHEN NOT contains(b, 'que') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(title, '(?i)(\\bmeme\\b|🚀|to the moon|diamond hands)') THEN 8 ELSE 0 END AS s FROM t)
SELECT conv_id, turn, floor(s * 10 + 0.5) / 10 AS score, CASE WHEN s >= 72 THEN 'high' WHEN s >= 48 THEN 'medium' ELSE 'low' END AS bucket FROM s""")
def fn_r04_posts(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    forum = F.when(k % 3 == 0, "Stocks").otherwise("pics")
    s = relevance.forum_points(F.substring("text", 1, 30), F.col("text"), forum, k % 1000, F.col("turn"), k % 4, "EN", "que", ["the", "der", "x"], True)
    return c.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.score", "s.bucket")


@query(_POSTED + """ SELECT conv_id, turn, round(CASE WHEN conv_id % 5 = 0 THEN 55 ELSE 0 END + CASE WHEN contains(lower(text), '$en') THEN 35 ELSE 0 END + CASE WHEN contains(lower(text), 'en') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 22 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), '(earnings|guidance|debt|bond|credit|downgrade|upgrade|refinanc|maturity|default|bankrupt|ebitda)') THEN 10 ELSE 0 END + CASE WHEN turn * 5 < 6 THEN 14 WHEN turn * 5 < 24 THEN 10 WHEN turn * 5 < 72 THEN 6 ELSE 0 END - CASE WHEN turn % 2 = 1 THEN 6 ELSE 0 END
 - CASE WHEN conv_id % 7 = 0 THEN 12 ELSE 0 END - CASE WHEN NOT contains(lower(text), '$en') AND NOT contains(lower(text), 'que') THEN 18 ELSE 0 END + least(18, 0.15 * (conv_id % 50 + 2 * turn + 2.5 * (conv_id % 3) + 0.0005 * conv_id)), 6) AS score FROM t""")
def fn_r05_posts(spark, sf_dir):
    c, k, turn = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(_AS_OF)) - turn * 5 * 3600)
    engaged = relevance.engagement(k % 50, turn, F.lit(None).cast("long"), k % 3, k)
    tags = F.when(k % 5 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("fr")))
    s = relevance.post_points(F.col("text"), tags, at, "EN", "que", F.lit(_AS_OF), turn % 2 == 1, k % 7 == 0, engaged, True)
    return c.select("conv_id", "turn", F.round(s, 6).alias("score"))


@query("SELECT event_id, round(value + 2 * (user_id % 3) + 1.5 * (user_id % 4) + 2.5 * (user_id % 5) + 0.0005 * event_id, 4) AS e FROM events")
def fn_r05_engagement(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(relevance.engagement(F.col("value"), u % 3, u % 4, u % 5, F.col("event_id")), 4).alias("e"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, html FROM pages), t AS (SELECT *, lower(title) AS lt, lower(title || chr(10) || html || chr(10)) AS b FROM p), s AS (
SELECT page_id, CASE WHEN contains(lt, 'en') THEN 35 WHEN contains(b, 'en') THEN 16 ELSE 0 END + CASE WHEN contains(lt, 'que') THEN 32 WHEN contains(b, 'que') THEN 18 ELSE 0 END + CASE WHEN contains(lt, 'the') OR contains(lt, 'der') THEN 18 ELSE 0 END
 + CASE WHEN regexp_matches(b, '(research|report|analysis|note|insight|outlook|webinar|podcast|transcript|presentation|distress|restructur|covenant|credit|high\\s+yield|leveraged|default|maturity|refinanc|bankrupt|chapter\\s+11)') THEN 14 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 16 ELSE 0 END
 + CASE WHEN page_id % 6 = 0 THEN 18 ELSE 0 END - CASE WHEN page_id % 5 = 0 THEN 18 ELSE 0 END - CASE WHEN regexp_matches(lower(CASE WHEN page_id % 3 = 0 THEN url || '/pro/bankruptcy' ELSE url END), '(login|signup|trial|careers|privacy|terms|about)') THEN 30 ELSE 0 END
 - CASE page_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 0 END - CASE WHEN NOT contains(b, 'que') THEN 14 ELSE 0 END AS s FROM t)
SELECT page_id, s::DOUBLE AS score, CASE WHEN s >= 70 THEN 'high' WHEN s >= 45 THEN 'medium' ELSE 'low' END AS bucket FROM s""")
def fn_r07_finder(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.when(k % 3 == 0, F.concat("url", F.lit("/pro/bankruptcy"))).otherwise(F.col("url"))
    s = relevance.page_points(
        F.regexp_extract("html", "<title>([^<]*)", 1), F.col("html"), F.lit(None).cast("string"), url, F.when(k % 6 == 0, "wsj_bankruptcy").otherwise("x"), F.when(k % 5 == 0, "generic_page").otherwise("report"), F.element_at(F.array(*map(F.lit, ["gated", "partially_gated", "public", "public"])), (k % 4 + 1).cast("int")),
        k % 2 == 0, "EN", "que", ["the", "der"], True,
    )
    return p.select("page_id", s.alias("s")).select("page_id", "s.score", "s.bucket")


@query("""SELECT c_custkey, greatest(0, least(100, CASE WHEN c_custkey % 17 = 0 AND NOT c_nationkey > 12 THEN least(25, CASE WHEN c_custkey % 13 = 0 THEN least(10, base) ELSE base END) ELSE CASE WHEN c_custkey % 13 = 0 THEN least(10, base) ELSE base END END
 - CASE WHEN c_nationkey % 2 = 0 THEN 10 ELSE 0 END - CASE WHEN c_acctbal < 0 THEN 15 ELSE 0 END))::INT AS score FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 40 WHEN 'AUTOMOBILE' THEN 35 WHEN 'MACHINERY' THEN 30 WHEN 'HOUSEHOLD' THEN 15 ELSE 0 END + CASE WHEN c_nationkey > 12 THEN 20 ELSE 0 END
 + CASE WHEN c_custkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 15 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS base FROM customer)""")
def fn_r08_relevance(spark, sf_dir):
    k = F.col("c_custkey")
    role = F.element_at(F.create_map(*map(F.lit, ["BUILDING", "co_issuer", "AUTOMOBILE", "guarantor", "MACHINERY", "pledgor", "HOUSEHOLD", "excluded_subsidiary", "FURNITURE", "other"])), F.col("c_mktsegment"))
    evidence = {"listed": F.col("c_nationkey") > 12, "ucc_debtor": k % 3 == 0, "material_collateral": k % 4 == 0, "collateral_kinds": k % 5 == 0, "same_city": k % 7 == 0}
    return table(spark, sf_dir, "customer").select("c_custkey", relevance.entity_points(role, evidence, k % 13 == 0, k % 17 == 0, F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") < 0).cast("int").alias("score"))


@query("""WITH a AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9 ]', ' ', 'g')) AS n FROM part), g AS (SELECT *, string_split(n, ' ') AS w, list_transform(range(1, length(n)), lambda i: substring(n, i, 2)) AS b FROM a),
x AS (SELECT unnest(['red widget', 'small gadjet']) AS alias), y AS (SELECT *, list_transform(range(1, length(alias)), lambda i: substring(alias, i, 2)) AS c, list_filter(string_split(alias, ' '), lambda z: length(z) > 2) AS v FROM x),
s AS (SELECT p_partkey, 2.0 * list_sum(list_transform(list_distinct(c), lambda z: least(len(list_filter(b, lambda q: q = z)), len(list_filter(c, lambda q: q = z))))) / (len(b) + len(c)) AS dice,
 len(list_intersect(list_filter(w, lambda z: length(z) > 2), v)) / least(len(list_distinct(list_filter(w, lambda z: length(z) > 2))), len(v)) AS common FROM g, y)
SELECT p_partkey, round(max(greatest(dice, common)), 9) AS s FROM s GROUP BY 1""")
def join_14_best_alias(spark, sf_dir):
    """By bigrams or by words, whichever is higher, of two aliases."""
    return research.best_alias(table(spark, sf_dir, "part"), "p_name", ["Réd Widget!", "small  gadjet"]).select("p_partkey", F.round("alias_score", 9).alias("s"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey AS idx, DATE '1998-12-31' - (o_orderkey % 500)::INT AS s, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1998-12-31' ELSE DATE '1997-12-31' END AS e FROM orders)
SELECT o_custkey, arg_min(idx, CASE WHEN s = DATE '1998-01-01' THEN 0 WHEN date_diff('day', s, e) + 1 BETWEEN 300 AND 400 THEN 1 ELSE 2 END * 1e10 + idx) FILTER (e = DATE '1998-12-31') AS idx FROM c GROUP BY 1""")
def agg_40_same_period(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 3 == 0, "1998-12-31").otherwise("1997-12-31")
    start = F.date_sub(F.lit("1998-12-31").cast("date"), (F.col("o_orderkey") % 500).cast("int")).cast("string")
    c = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), start.alias("start"), end.alias("end"))
    return research.same_period(c, "o_custkey", "1998-01-01", "1998-12-31")


@query("""WITH d AS (SELECT l_orderkey AS owner, sum(CASE WHEN l_returnflag = 'N' THEN 1.5 ELSE 4 END) AS d, bool_or(l_linenumber = 7) AS a, 6 * count(*) FILTER (l_quantity::INT % 4 = 0) AS cl FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey AS owner, count(*) AS n, sum(CASE l_linenumber % 3 WHEN 0 THEN 14 + 5 + 14 WHEN 1 THEN 5 ELSE 0 END) AS c, sum(CASE WHEN l_linenumber = 2 THEN 24 ELSE 0 END) AS e, sum(CASE WHEN l_quantity::INT % 5 = 0 THEN 10 ELSE 0 END) AS m, sum(CASE WHEN l_quantity::INT % 7 = 0 THEN 9 ELSE 0 END) AS w,
 sum(CASE WHEN l_linenumber % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END) AS p, count(*) FILTER (l_returnflag = 'A') AS high, count(*) FILTER (l_returnflag = 'N') AS low FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS owner, o_orderkey % 4 AS errors FROM orders), j AS (SELECT s.owner, least(100, coalesce(d, 0) + CASE WHEN a THEN 12 ELSE 0 END)::DOUBLE AS disclosure, least(100, coalesce(c, 0) + least(40, coalesce(n, 0) * 2))::DOUBLE AS compliance, least(100, coalesce(e, 0))::DOUBLE AS enforcement,
 least(100, coalesce(m, 0) + CASE WHEN m > 0 THEN 8 ELSE 0 END)::DOUBLE AS emissions, least(100, coalesce(w, 0) + coalesce(cl, 0))::DOUBLE AS waste, least(100, coalesce(n, 0) * 3 + coalesce(p, 0))::DOUBLE AS permits, greatest(0, least(100, 100 - errors * 8 - coalesce(low, 0) * 3 - CASE WHEN n IS NULL THEN 35 ELSE 0 END + coalesce(high, 0) * 2))::DOUBLE AS confidence
 FROM s LEFT JOIN d ON s.owner = d.owner LEFT JOIN f ON s.owner = f.owner)
SELECT owner, floor(disclosure + 0.5)::BIGINT AS disclosure, floor(compliance + 0.5)::BIGINT AS compliance, enforcement::BIGINT AS enforcement, emissions::BIGINT AS emissions, waste::BIGINT AS waste, permits::BIGINT AS permits, confidence::BIGINT AS confidence,
 floor(least(100, greatest(0, 0.0::DOUBLE + disclosure * 0.2::DOUBLE + compliance * 0.18::DOUBLE + enforcement * 0.17::DOUBLE + emissions * 0.12::DOUBLE + waste * 0.13::DOUBLE + permits * 0.1::DOUBLE + (100 - confidence) * 0.1::DOUBLE)) + 0.5)::BIGINT AS overall FROM j""")
def agg_35_risk_scores(spark, sf_dir):
    """Orders as owners; their lines stand for disclosures and for facilities."""
    li = table(spark, sf_dir, "lineitem").withColumn("owner", F.col("l_orderkey")).withColumn("q", F.col("l_quantity").cast("int"))
    n, lit = F.col("l_linenumber"), F.lit
    none = F.array().cast("array<string>")
    flags = lambda c, *v: F.when(c, F.array(*map(lit, v)))
    d = li.select("owner", F.when(F.col("l_returnflag") == "N", "other").otherwise("air").alias("topic"), F.when(n == 7, "$5").alias("amount"), F.when(F.col("q") % 4 == 0, "a Superfund site").otherwise("none").alias("text"))
    f = li.select(
        "owner", F.when(n % 3 == 0, F.array(lit("Significant Violation"), lit("minor"), lit("noncompliance"))).when(n % 3 == 1, F.array(lit("late"))).otherwise(none).alias("compliance"), flags(n == 2, "a", "b").alias("enforcement"), flags(F.col("q") % 5 == 0, "x").alias("emissions"), flags(F.col("q") % 7 == 0, "y").alias("waste"),
        F.element_at(F.create_map(lit("A"), lit("high"), lit("N"), lit("unresolved"), lit("R"), lit("medium")), F.col("l_returnflag")).alias("match"), F.when(F.col("l_returnflag") == "R", "0").alias("inspections"),
    )
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), (F.col("o_orderkey") % 4).alias("errors"))
    return environment.risk_scores(owners, d, f)


_CONCEPTS = [
    ("us:Revenues", "is"), ("RevenueFromContractWithCustomerX", "is"), ("x:CostRevenue", "is"), ("OperatingExpensesOther", "is"), ("NetIncomeLoss", "is"), ("a:Assets", "bs"), ("AssetsCurrentNet", "bs"), ("CashAndCashEquivalentsAtCarryingValue", "bs"), ("Assets", "is"), ("PaymentsToAcquirePropertyPlantAndEquipment", "cf"),
    ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect", "cf"), ("x:Some Thing!", "is"), (" : ", "bs"),
]


@query("""WITH p AS (SELECT p_partkey, p_partkey % 13 AS i, regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS t FROM part), c AS (SELECT *, ['revenue', 'revenue', 'cost_of_revenue', NULL, NULL, NULL, 'current_assets', 'cash', NULL, 'capex', NULL, NULL, NULL][i + 1] AS line FROM p)
SELECT p_partkey, coalesce(line, CASE i WHEN 3 THEN 'unmapped__operatingexpensesother' || lower(t) WHEN 4 THEN 'unmapped__netincomeloss' || lower(t) WHEN 5 THEN 'unmapped__assets' || lower(t) WHEN 8 THEN 'unmapped__assets' || lower(t) WHEN 10 THEN 'unmapped__cashcashequivalentsrestrictedcashandrestrictedcashequivalentsperiodincreasedecreaseexcludingexchangerateeffect' || lower(t)
 WHEN 11 THEN 'unmapped__some_thing_' || lower(t) ELSE 'unmapped__' || lower(t) END) AS line, CASE i WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 6 THEN 20 WHEN 7 THEN 25 WHEN 9 THEN 25 ELSE 9000 END::INT AS sort_order,
 CASE i WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Revenue' WHEN 2 THEN 'Cost of revenue' WHEN 6 THEN 'Current assets' WHEN 7 THEN 'Cash and cash equivalents' WHEN 9 THEN 'Capital expenditures' WHEN 3 THEN 'OperatingExpensesOther' || t WHEN 4 THEN 'NetIncomeLoss' || t WHEN 5 THEN 'Assets' || t WHEN 8 THEN 'Assets' || t
 WHEN 10 THEN 'CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect' || t WHEN 11 THEN 'Some Thing!' || t ELSE t END AS label, CASE WHEN line IS NULL THEN 'no_rule_matched_kept_separate' ELSE 'rule_match' END AS note FROM c""")
def fn_c08_standard_lines(spark, sf_dir):
    """Concepts with each part's type at their end, so that patterns bound to the end don't fit."""
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _CONCEPTS]), (F.col("p_partkey") % 13 + 1).cast("int"))
    line = rules.standard_line(F.concat(pick(0), F.regexp_replace("p_type", "[^A-Za-z]", "")), pick(1))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("l")).select("p_partkey", "l.line", "l.sort_order", "l.label", "l.note")


_ROLES = [
    ("http://x/role/CONSOLIDATEDSTATEMENTSOFOPERATIONS", "is"), ("http://x/role/BalanceSheets", "bs"), ("role/Statements of Cash Flows", "cf"), ("role/IncomeStatementDetails", None), ("http://x/role/disclosureBalanceSheet", None), ("http://xbrl.sec.gov/ecd/role/StatementOfIncome", None), ("x/StatementsOfComprehensiveLoss", None),
    ("x/ConsolidatedStatementsOfComprehensiveLoss", "is"), ("x/Statements-of-comprehensive_income", "is"), ("x/AccumulatedOtherComprehensiveIncome", None), ("x/BalanceSheetParenthetical", None), ("x/ConsolidatedStatementsOfShareholdersEquity", None), ("x/ProfitAndLoss", "is"), ("x/CashAndDebtFlow", "cf"),
]


@query("""SELECT p_partkey, ['is', 'bs', 'cf', NULL, NULL, NULL, NULL, 'is', 'is', NULL, NULL, NULL, 'is', 'cf'][p_partkey % 14 + 1] AS kind, CASE WHEN p_size % 4 = 1 THEN -p_retailprice ELSE p_retailprice END AS shown FROM part""")
def flt_06_fn_m05_roles(spark, sf_dir):
    """Roles under each part's brand, one for each rule of the classifier."""
    role = F.element_at(F.array(*[F.lit(r) for r, _ in _ROLES]), (F.col("p_partkey") % 14 + 1).cast("int"))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_size") % 4 + 1).cast("int"))
    branded = F.concat(F.lit("http://"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".com/"), role)
    return table(spark, sf_dir, "part").select("p_partkey", rules.statement_role(branded).alias("kind"), rules.display_sign(F.col("p_retailprice"), pick("label", "negatedLabel", "total", None)).alias("shown"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents")
def fn_s12_plain_texts(spark, sf_dir):
    """Whole texts without marks; the tables' texts have no letters that only compatibility decomposition changes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.plain_letters(F.col("text")).cast("binary")).alias("plain_md5"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'high' WHEN l_returnflag = 'R' THEN 'unresolved' WHEN l_quantity / 50 >= 0.52 THEN 'high' WHEN l_quantity / 50 >= 0.28 THEN 'medium' WHEN l_quantity / 50 >= 0.12 THEN 'low' ELSE 'unresolved' END AS confidence,
 round(l_discount * 40 + 6 * (l_linenumber % 3) + 10 * (l_linenumber % 2) + 4 * (l_linenumber % 5) + 5 * (l_linenumber % 4) + CASE WHEN l_linestatus = 'F' THEN 25 ELSE 0 END, 6) AS score FROM lineitem""")
def fn_r12_facilities(spark, sf_dir):
    """Every line as a facility: its confidence by score and override, and its points by flags."""
    n = F.col("l_linenumber").cast("int")
    override = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "rejected").otherwise("none")
    flags = [F.array_repeat(F.lit("f"), n % k) for k in (3, 2, 5, 4)]
    points = scores.facility_score(F.col("l_discount").cast("double"), *flags, F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.match_confidence(F.col("l_quantity") / 50, override).alias("confidence"), F.round(points, 6).alias("score"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 AND f / n >= 0.5 AND p <= 3 THEN 'high' WHEN f / n >= 0.25 AND (o_custkey % 3 = 0 OR o_custkey % 2 = 0) THEN 'medium' ELSE 'low' END AS quality FROM c""")
def fn_r11_coverage_of_customers(spark, sf_dir):
    """A customer's orders as recommended searches: filled ones are checked, partial ones unresolved."""
    status, k = F.col("o_orderstatus"), F.col("o_custkey")
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(status == "F").alias("f"), F.count_if(status == "P").alias("p"))
    return c.select("o_custkey", scores.coverage_quality(F.col("n"), F.col("f"), F.col("p"), k % 2 == 0, k % 3 == 0).alias("quality"))


@query("""SELECT o_orderkey, CASE WHEN fp = 'FY' AND form IN ('10-K', '20-F', '40-F') THEN 'annual' WHEN fp <> 'FY' AND form IN ('10-Q', '10-K') THEN 'quarter' ELSE 'other' END AS kind
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'FY' ELSE 'Q' || quarter(o_orderdate) END AS fp, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '20-F' WHEN '5-LOW' THEN '40-F' ELSE '8-K' END AS form FROM orders)""")
def flt_04_periods_of_orders(spark, sf_dir):
    fp = F.when(F.col("o_custkey") % 5 == 0, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    form = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ["1-URGENT", "10-K", "2-HIGH", "10-Q", "3-MEDIUM", "20-F", "5-LOW", "40-F"])), F.col("o_orderpriority")), F.lit("8-K"))
    kind = F.when(classes.annual_period(fp, form), "annual").when(classes.quarter_period(fp, form), "quarter").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS t FROM documents)
SELECT doc_id, count(*) FILTER (length(t) <= 2 OR upper(t) IN ('IT', 'AI', 'ON', 'IN', 'AT', 'AS', 'OR', 'AN', 'BE', 'BY', 'US', 'WE')) AS n_ambiguous FROM w GROUP BY 1""")
def fn_c13_ambiguous_words(spark, sf_dir):
    """Every word of every text as a ticker."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    n = F.size(F.filter(words, classes.ambiguous_ticker)).cast("long")
    return table(spark, sf_dir, "documents").where(F.size(words) > 0).select("doc_id", n.alias("n_ambiguous"))


@query(f"""WITH d AS (SELECT doc_id, {_NORMAL.format('text')} AS t, {_NORMAL.format('substring(text, 1, 400)')} AS a, {_NORMAL.format('substring(text, 201, 400)')} AS b FROM documents),
w AS (SELECT doc_id, t, list_distinct(list_filter(string_split(a, ' '), lambda x: length(x) > 2)) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: length(x) > 2)) AS y FROM d)
SELECT doc_id, length(t) AS n_normal, md5(t) AS normal_md5, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 9) AS jaccard,
 round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END, 9) AS shared FROM w""")
def fn_s05_s06_s08_texts(spark, sf_dir):
    """Whole texts in the form of titles, and the likeness of two stretches of each that lie half over each other."""
    t = F.coalesce("text", F.lit(""))
    a, b = (tx.word_set(F.substring(t, i, 400), 2) for i in (1, 201))
    # each form of a text once, however often it is compared
    title = tx.once(tx.match_title(t), lambda m: F.struct(F.length(m).cast("long").alias("n_normal"), F.md5(m.cast("binary")).alias("normal_md5")))
    alike = tx.once(F.struct(a.alias("a"), b.alias("b")), lambda x: F.struct(F.round(tx.jaccard(x["a"], x["b"]), 9).alias("jaccard"), F.round(tx.overlap(x["a"], x["b"]), 9).alias("shared")))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("m"), alike.alias("x")).select("doc_id", "m.*", "x.*")
