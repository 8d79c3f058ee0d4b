"""Queries of merges, rankings, grids and gates whose answers depend on many rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import classes, keep, scores
from tallyframe.functions import text as tx
from tallyframe.operators import application as app
from tallyframe.operators import coverage, filings, research, search
from tallyframe.plans.queries import FACTS, facts, files, hits, query, table
from tallyframe.plans.queries_cases import cases
from tallyframe.session import materialize
from tallyframe.streaming import daily


@query("SELECT event_type, count(*) FILTER (value >= 50) AS high, count(DISTINCT user_id) AS users, floor(avg(CASE WHEN user_id % 3 <> 0 THEN value END) * 10 + 0.5) / 10 AS mean FROM events GROUP BY 1")
def agg_22_summary(spark, sf_dir):
    value = F.when(F.col("user_id") % 3 != 0, F.col("value"))
    return app.summary(table(spark, sf_dir, "events"), ["event_type"], {"high": F.col("value") >= 50}, {"users": F.col("user_id")}, {"mean": value})


@query("""WITH m AS (SELECT DISTINCT conv_id AS conv, role AS usr FROM conversations), f AS (SELECT *, CASE WHEN conv % 3 = 0 THEN NULL WHEN conv % 3 = 1 THEN 1 ELSE 2 END AS last FROM m)
SELECT conv, usr AS "user", count(*) FILTER (turn > coalesce(last, 0) AND role <> usr AND (turn % 4 <> 3 OR usr = 'user')) AS unread FROM f JOIN conversations ON conv = conv_id GROUP BY ALL""")
def agg_21_unread(spark, sf_dir):
    """A third of the members never read and count from joining; some messages are for one role only."""
    c = table(spark, sf_dir, "conversations")
    last = F.when(F.col("conv") % 3 == 0, None).when(F.col("conv") % 3 == 1, 1).otherwise(2).cast("long")
    members = c.select(F.col("conv_id").alias("conv"), F.col("role").alias("user")).distinct().withColumn("joined_at", F.lit(0).cast("long")).withColumn("last_read_at", last)
    messages = c.select(F.col("conv_id").alias("conv"), F.col("role").alias("sender"), F.col("turn").alias("at"), F.when(F.col("turn") % 4 == 3, "user").alias("visible_to"))
    return app.unread_counts(members, messages)


@query("SELECT event_id FROM events WHERE (event_id % 5 > 1 OR user_id = 7) AND ts >= TIMESTAMP '2024-01-05'")
def flt_15_visible_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("to", F.when(F.col("event_id") % 5 <= 1, F.col("user_id")))
    return app.visible(e, "to", F.lit(7), "ts", F.to_timestamp(F.lit("2024-01-05"))).select("event_id")


@query("""WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) SELECT conv_id, turn, conv_id % 4 = 1 AS is_lobby FROM l ORDER BY is_lobby DESC, turn DESC, conv_id LIMIT 100""")
def topk_13_inbox(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return app.inbox(last, F.col("conv_id") % 4 == 1, "turn", "conv_id").select("conv_id", "turn", "is_lobby")


@query("""SELECT p_partkey AS k, p_size::BIGINT AS v FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1) UNION ALL SELECT p_partkey, -1 FROM part WHERE p_size = 1""")
def snk_06_replace_all(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    new = p.where("p_size = 1").select(F.col("p_partkey").alias("k"), "p_brand", F.lit(-1).cast("long").alias("v"))
    return app.replace_all(p.select(F.col("p_partkey").alias("k"), "p_brand", F.col("p_size").cast("long").alias("v")), new, "p_brand").select("k", "v")


@query("SELECT arg_min(trim(CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END), event_id) AS entity, sum(user_id % 10)::BIGINT AS n FROM events GROUP BY lower(event_type)")
def agg_28_facets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type"))
    return research.facet_counts(e.select(name.alias("entity"), (F.col("user_id") % 10).alias("n"), F.col("event_id").alias("pos")), "entity", "n", "pos")


_KINDS = ("DIP loan", "Exit  facility", "Revolver", "Senior secured notes", "Form of note", "Convertible debentures", "Securitization trust", "Lease")
_GROUPS = ("DIP / exit financing", "DIP / exit financing", "Revolver / ABL / term loan", "Secured notes", "Unsecured notes", "Convertible / exchangeable notes", "Securitization / ABS facilities", "Other")


@query(f"SELECT ({list(_GROUPS)}::VARCHAR[])[o_orderkey % 8 + 1] AS bucket, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def agg_29_debt_buckets(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").withColumn("bucket", classes.debt_bucket(F.lit(""), name))
    return o.groupBy("bucket").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query("SELECT o_custkey, floor(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) * 10 + 0.5) / 10 AS mean FROM orders GROUP BY 1")
def agg_31_mean(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(keep.rounded_mean(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("mean"))


@query("""WITH s AS (SELECT p_brand, (CASE WHEN p_name LIKE '%red%' THEN 30 ELSE 0 END + CASE WHEN p_name LIKE '%widget%' THEN 25 ELSE 0 END + CASE WHEN p_type LIKE '%ECON%' THEN 9 ELSE 0 END)::DOUBLE AS s FROM part)
SELECT p_brand, max(s) AS best, sum(least(40, s)) AS total FROM s GROUP BY 1""")
def agg_32_table_scores(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type")
    return research.table_scores(table(spark, sf_dir, "part"), "p_brand", text, [("red", 30.0), ("widget", 25.0), ("ECON", 9.0)], 40.0)


@query("SELECT c_custkey, (c_nationkey * 4 + c_custkey % 3 * 6 + CASE WHEN c_custkey % 7 = 0 THEN 25 ELSE 0 END)::DOUBLE AS score FROM customer ORDER BY score DESC, c_name LIMIT 80")
def topk_10_facilities(spark, sf_dir):
    flags, none = F.array_repeat(F.lit("x"), (F.col("c_custkey") % 3).cast("int")), F.array().cast("array<string>")
    score = scores.facility_score(F.col("c_nationkey") / 10, flags, none, none, none, F.col("c_custkey") % 7 == 0)
    return research.rank_facilities(table(spark, sf_dir, "customer"), score, "c_name").select("c_custkey", F.col("score").cast("double").alias("score"))


cases(
    "topk_16_exhibit_files",
    [
        (("dex21.htm",), 0), (("x-ex21.htm",), 120), (("exhibit21-1.htm",), 100), (("ex21-exhibit21.txt",), 220), (("subsidiaries.htm",), 50), (("list of subsidiary.htm",), 50), (("exhibit31-ex21.htm",), 35), (("x_ex21.xsl",), 0), (("ex210.htm",), 0),
    ],
    lambda n: classes.exhibit_21_file(n),
)
cases("flt_17_paths", [(("a/b.TXT",), True), (("a.html",), True), (("a.htm",), True), (("a.pdf",), False), (("txt",), False)], classes.text_file)


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, (o_orderkey % 5) * 30 AS points FROM orders) SELECT o_custkey, o_orderkey FROM c WHERE points >= 50 AND o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, points DESC, o_orderkey) = 1""")
def src_39_first_valid_exhibit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("newer", -F.unix_timestamp("o_orderdate"))
    ranked = research.rank_files(o, "o_orderkey", (F.col("o_orderkey") % 5) * 30).withColumn("better", -F.col("score"))
    return research.first_valid(ranked, "o_custkey", ["newer", "better", "o_orderkey"], F.col("o_orderkey") % 3 == 0).select("o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT l_linenumber, l_returnflag, year(l_shipdate)::INT AS fy, CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS value, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey AS pos,
CASE l_linenumber % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'cash' WHEN 2 THEN 'cfo' ELSE 'unmapped__thing_x' END AS line, CASE l_linenumber % 4 WHEN 0 THEN 'is' WHEN 1 THEN 'bs' WHEN 2 THEN 'cf' ELSE 'is' END AS statement, CASE l_linenumber % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 10 ELSE 9000 END::INT AS sort_order FROM lineitem)
SELECT statement, line, fy, arg_min(value, pos) AS value, min(sort_order) AS sort_order FROM f WHERE value IS NOT NULL GROUP BY ALL""")
def agg_15_statement_grid(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    f = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000000000 + F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("pos"), pick("is", "bs", "cf", "is").alias("statement"), F.year("l_shipdate").alias("fy"), F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).alias("value"),
        pick("us-gaap:RevenueFromContractWithCustomerX", "CashAndCashEquivalentsAtCarryingValue", "us:NetCashProvidedByUsedInOperatingActivities", "x:Thing X").alias("concept"),
    )
    return research.statement_grid(f)


@query("SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, lpad((99999999 - (epoch(o_orderdate) / 86400)::INT)::VARCHAR, 12, '0') || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY ALL")
def agg_13_merge_ordered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("filed", F.unix_date(F.to_date("o_orderdate")))
    return research.merge_ordered(o, ["o_custkey", "o_orderstatus"], "filed", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderdate::DATE, o_orderkey) AS day FROM orders GROUP BY 1")
def dedup_18_latest_periods(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return research.latest_periods(o, ["o_custkey"], "o_orderkey", "day")


@query("""WITH a AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 2 = 0 THEN 'n ' || (s_suppkey % 40)::VARCHAR ELSE ' N ' || (s_suppkey % 40)::VARCHAR END AS name FROM supplier), b AS (SELECT c_custkey AS pos, 'n ' || (c_custkey % 60)::VARCHAR AS name FROM customer),
u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b) SELECT trim(name) AS name, source FROM u WHERE lower(trim(name)) <> 'n 3' QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY source, pos) = 1""")
def dedup_19_merge_names(spark, sf_dir):
    number = F.col("s_suppkey") % 40
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n "), number.cast("string"))).otherwise(F.concat(F.lit(" N "), number.cast("string"))).alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("n "), (F.col("c_custkey") % 60).cast("string")).alias("name"))
    return research.merge_names(a, b, "name", "pos", spark.createDataFrame([("N 3 ",)], "name string"))


@query("""WITH a AS (SELECT DISTINCT upper(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM customer), b AS (SELECT DISTINCT 'CUSTOMER ' || lpad((s_suppkey * 2)::VARCHAR, 9, '0') AS norm FROM supplier)
SELECT coalesce(a.norm, b.norm) AS norm, a.norm IS NOT NULL AS in_left, b.norm IS NOT NULL AS in_right FROM a FULL JOIN b ON a.norm = b.norm""")
def join_31_name_sets(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" Customer-"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")).alias("name"))
    return research.name_sets(left, right, "name")


@query("SELECT p_partkey, x AS scope, p_name || ' site:' || x AS scoped FROM part, (SELECT unnest(['a.com', 'b.org', 'c.net']) AS x)")
def join_18_scoped_queries(spark, sf_dir):
    return search.expand_queries(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["a.com", "b.org", "c.net"]).select("p_partkey", "scope", "scoped")


@query("""SELECT * FROM (SELECT 'relevance' AS mode, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'recent', o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 50) UNION ALL SELECT * FROM (SELECT 'name', o_orderkey FROM orders ORDER BY lower(o_orderpriority), o_orderdate DESC, o_orderkey LIMIT 50)""")
def topk_08_ranking_modes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("known"))
    parts = [search.rank_hits(o, mode, "o_totalprice", "known" if mode == "recent" else "o_orderdate", "o_orderpriority", "o_orderkey", 50).select(F.lit(mode).alias("mode"), "o_orderkey") for mode in ("relevance", "recent", "name")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name, [c_mktsegment] AS tags FROM customer), b AS (SELECT s_suppkey * 3 AS k, s_name AS name, ['x', 'BUILDING'] AS tags FROM supplier)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags,
CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'merged' WHEN a.k IS NOT NULL THEN 'stored' ELSE 'live' END AS source FROM a FULL JOIN b ON a.k = b.k""")
def dedup_07_merge_sources(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("name"), F.array(F.lit("x"), F.lit("BUILDING")).alias("tags"))
    return search.merge_sources(a, b, "k", ["tags"]).withColumn("tags", F.array_join("tags", ","))


@query()
def dedup_03_broker_clusters(spark, sf_dir):
    """Notes of one broker within two days of each other; each broker's clusters are its own."""
    rows = hits(spark, sf_dir).withColumn("words", tx.word_set(F.col("title"))).withColumn("no_url", F.lit(None).cast("string"))
    return search.greedy_clusters(rows, "id", "no_url", "words", "at", [-F.col("score"), F.col("id")], 0.82, 48.0, "provider")


@query("""WITH f AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-11' - INTERVAL 36 HOUR AND TIMESTAMP '2024-01-11')
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, event_type, arg_max(event_id, lpad(epoch_us(ts)::VARCHAR, 20, '0')) AS event_id FROM f GROUP BY ALL""")
def str_03_daily_batch(spark, sf_dir):
    out = daily.daily_batch(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "2024-01-11 00:00:00", 36)
    return out.select("user_id", "day", "event_type", "event_id")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997")
def flt_13_years(spark, sf_dir):
    return research.year_range(table(spark, sf_dir, "orders"), F.year("o_orderdate"), 1995, 1997).select("o_orderkey")


cases("fn_s12_plain_letters", [(("Société Générale",), "Societe Generale"), (("Ãñdré é",), "Andre e"), (("plain",), "plain")], tx.plain_letters)
cases("fn_d01_times", [(("2024-01-02T03:04:05Z",), 1704164645), (("20240102T030405",), 1704164645), (("1704164645",), 1704164645), (("2024-01-02",), 1704153600), (("soon",), None), (("12",), None)], lambda t: F.unix_timestamp(tx.iso_time(t)).cast("int"))
cases("fn_a01_upper_union", [(("a,B", "b,c"), "A,B,C"), (("", "x"), ",X"), (("x,X,y", "Y"), "X,Y")], lambda a, b: F.array_join(tx.upper_union(F.split(a, ","), F.split(b, ",")), ","))
cases("fn_a03_rectangular", [(("a,b|c",), "a,b|c,"), (("a",), "a"), (("a|b,c,d|",), "a,,|b,c,d|,,")], lambda g: F.array_join(F.transform(tx.rectangular(F.transform(F.split(g, "[|]"), lambda r: F.split(r, ","))), lambda r: F.array_join(r, ",")), "|"))
cases("fn_s08_overlap", [(("alpha beta gamma", "beta gamma delta eps"), 2 / 3), (("", "alpha"), 0.0), (("one two", "one"), 1.0)], lambda a, b: tx.overlap(tx.word_set(a, 2), tx.word_set(b, 2)))
cases("fn_s13_lines", [(("<p>a &amp; b</p><p>c<br>d</p><script>x</script>",), "a & b;c;d"), (("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>",), "1 2;3"), (("x",), "x")], lambda h: F.replace(tx.html_to_lines(h), F.lit("\n"), F.lit(";")))
cases("fn_s30_links", [(("see https://a.com/x, and http://b.org/y. https://a.com/x",), "https://a.com/x http://b.org/y"), (("none",), "")], lambda t: F.array_join(tx.links(t), " "))
cases(
    "fn_s17_numbers_and_dates",
    [
        (("on 2024-01-02 and 1/2/24",), "2024-01-02;1/2/24"), (("Jan. 5, 2023 in Q3 2022, FY23",), "Jan. 5, 2023;Q3 2022;FY23"), (("$5 million or 1,234.5 at 7.5% and 7.5%pa",), "1,234.5;$5 million;7.5%"), (("nothing",), ""),
    ],
    lambda t: F.array_join(tx.numbers_and_dates(t), ";"),
)
cases("fn_s05_s06_similar_titles", [(("A big deal", "a BIG deal!", 10), True), (("A big deal", "a big deal today now", 10), False), (("A big deal", "a big deal", 8000), False)], lambda a, b, s: (tx.jaccard(tx.word_set(a), tx.word_set(b)) >= 0.82) & (s <= 7200))


def _covered(spark, sf_dir):
    """Concepts AF and NO are mapped, NF has facts but no entry, RF comes from the unresolved queue, XX is a line
    without facts, AO and RO have facts but no line, ZZ is a queue entry that no sheet has; some mapped cells are missing."""
    all_facts = materialize(facts(spark, sf_dir).select("stmt", "concept", "period", "file", "value"), "facts")  # the one join that all passes read
    recency = materialize(files(spark, sf_dir), "files")
    own = all_facts.where("concept <> 'RF'")
    stmt = "income_statement"
    rows = spark.createDataFrame([(stmt, "A", 0), (stmt, "N", 1)], "stmt string, row_id string, display_order int")
    entries = spark.createDataFrame([(stmt, "AF", "A"), (stmt, "NO", "N")], "stmt string, concept string, row_id string")
    lines = spark.createDataFrame([(stmt, "b.xlsx", i, c) for i, c in enumerate(("AF", "NF", "NO", "RF", "XX"))], "stmt string, file string, pos int, concept string")
    kept = own.where("concept = 'AF' and period not like '1Q%'").join(recency, "file").groupBy("stmt", F.lit("A").alias("row_id"), "period").agg(F.max_by("value", "recency").alias("value"))
    rest = all_facts.where("concept = 'RF'")
    zz = spark.createDataFrame([(stmt, "ZZ", "1Q20", "1-URGENT", 7.0), (stmt, "", "1Q20", "1-URGENT", 1.0), (stmt, "YY", "no period", "1-URGENT", 1.0), (stmt, "YY", "1Q20", "1-URGENT", None)], "stmt string, concept string, period string, file string, value double")
    return coverage.cover(rows, entries, kept, own, rest.unionByName(zz), lines, recency)


@query(f"""WITH {FACTS.strip()}, m AS (SELECT * FROM (VALUES ('AF', 'A'), ('NO', 'N'), ('NF', 'NF'), ('RF', 'RF'), ('AO', 'AO'), ('RO', 'RO')) AS t(concept, target)),
c AS (SELECT target AS row_id, period, arg_max(value, recency) AS value FROM facts JOIN m USING (concept) JOIN files USING (file) GROUP BY ALL)
SELECT row_id, period, value, CASE WHEN row_id = 'A' AND period NOT LIKE '1Q%' THEN 'consolidated' WHEN row_id IN ('A', 'N') THEN 'repaired' WHEN row_id <> 'RF' THEN 'explicit_workbook_line' ELSE 'coverage_integrated' END AS how FROM c
UNION ALL SELECT 'ZZ', '1Q20', 7.0, 'coverage_integrated'""")
def cov_08_passes(spark, sf_dir):
    return _covered(spark, sf_dir)[0].cells.select("row_id", "period", "value", "how")


@query("""SELECT row_id, display_order FROM (VALUES ('ZZ', 0), ('AO', 1), ('RO', 2), ('A', 3), ('NF', 4), ('N', 5), ('RF', 6), ('XX', 7)) AS t(row_id, display_order)""")
def cov_03_04_rows(spark, sf_dir):
    return _covered(spark, sf_dir)[0].rows.select("row_id", "display_order")


cases("fn_s11_generic_agents", [(("C T Corporation System",), True), (("CSC",), True), (("The Corporation Trust  Company",), True), (("Harvard Business Services",), True), (("Acme Agents",), True), (("John Doe",), False), ((None,), False)], lambda n: classes.generic_agent(n, [r"\bACME\b"]))
cases("fn_s23_states", [(("1 MAIN ST, DOVER, DE 19901",), "DE"), (("1 MAIN ST DE 19901-1234",), ""), (("DOVER DE",), "")], classes.state_of)
cases("fn_j02_states", [(('[{"state": "ny"}, {"x": 1}, {"state": "Tx"}]',), "NY,TX"), (("[]",), ""), (('{"state": "ny"}',), "NY"), (("none",), "")], lambda j: F.array_join(classes.states_in(j), ","))
cases("src_11_spellings", [(("brk.b",), "BRK.B,BRK-B"), (("BRK B",), "BRK B,BRKB,BRK-B"), ((" t ",), "T"), (("",), "")], lambda t: F.array_join(classes.ticker_spellings(t), ","))
cases(
    "fn_s20_company_names",
    [
        (("Buy $GE now",), "ticker 0.3"), (("NYSE: GE and General Electric",), "mixed 0.9"), (("general electric",), "company 0.75"), (("about gecorp",), "alias 0.52"), (("image",), "none 0.0"), (("GE, GECORP",), "mixed 0.9"),
    ],
    lambda t: F.concat_ws(" ", classes.names_company(t, "GE", "General Electric", ["GE", "gecorp"])["kind"], F.round(classes.names_company(t, "GE", "General Electric", ["GE", "gecorp"])["confidence"], 2).cast("string")),
)
cases(
    "flt_19_contents_tables",
    [
        (("item 1,a|item 2,b|item 3,c|item 4,d|item 5,e",), True), (("table of contents,x|a,b|c,d|e,f",), True), (("Part I,x|item 1,item 2|item 3,item 4|y,z|q,w",), True), (("Assets,1|Cash,2|Debt,3|Equity,4|Other,5",), False), (("item 1,a|item 2,b",), False),
    ],
    lambda g: classes.contents_table(F.transform(F.split(g, "[|]"), lambda r: F.split(r, ","))),
)


@query("""WITH d AS (SELECT 'C' || c_custkey::VARCHAR || '-A' AS ticker, c_custkey AS cik FROM customer), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '00' || (1000000 + o_orderkey)::VARCHAR ELSE lower('C' || o_custkey::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '.A' ELSE ' A' END) END AS asked, o_custkey FROM orders)
SELECT o_orderkey, lpad(CASE WHEN o_orderkey % 5 = 0 THEN asked ELSE d.cik::VARCHAR END, 10, '0') AS cik FROM a LEFT JOIN d ON o_custkey = d.cik""")
def src_11_tickers(spark, sf_dir):
    directory = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("-A")).alias("ticker"), F.col("c_custkey").alias("cik"))
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("00"), (k + 1000000).cast("string"))).otherwise(F.lower(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, ".A").otherwise(" A"))))
    return filings.lookup_tickers(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("asked")), directory, "asked").select("o_orderkey", "cik")


@query("""SELECT c_custkey, concept, label FROM customer, (VALUES ('us-gaap:Revenues', 'Net revenue & other'), ('acme:Other', 'acme:Other')) AS t(concept, label)""")
def src_16_viewer_rows(spark, sf_dir):
    row = lambda n, label: f"<a onclick=\"Show.showAR( this, 'defref_{n}', window )\">{label}</a>"
    page = F.lit(row("us-gaap_Revenues", "Net <b>revenue</b> &amp; other") + row("acme_Other", " ") + row("us-gaap_Revenues", "again"))
    return filings.viewer_concepts(table(spark, sf_dir, "customer").withColumn("html", page), "c_custkey", "html").select("c_custkey", "concept", "label")


@query("WITH n AS (SELECT o_custkey, o_orderkey, o_orderkey % 16 AS n, lead(o_orderkey % 16) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nn FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE NOT coalesce(n >= 9 AND nn <= 8 AND nn < n - 3, false)")
def flt_23_stray_headings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("number", F.col("o_orderkey") % 16)
    return filings.drop_stray_headings(o, "o_custkey", "o_orderkey", "number").select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT c_custkey AS k, 1000.0 + c_acctbal AS a, c_custkey % 4 AS m FROM customer)
SELECT k, 'assets' AS name, round(CASE WHEN m = 1 THEN 50 ELSE 0 END, 4)::DOUBLE AS gap, m <> 1 AS passed FROM c UNION ALL SELECT k, 'net_income', CASE WHEN m = 2 THEN 3 ELSE 0 END, m <> 2 FROM c WHERE m <> 3 UNION ALL SELECT k, 'cash', CASE WHEN m = 0 THEN 7 ELSE 0 END, true FROM c""")
def val_04_structure(spark, sf_dir):
    """Balance, income and cash checks of a statement for each customer: some gaps, some lines missing, some second names."""
    m, a = F.col("c_custkey") % 4, F.col("c_acctbal") + 1000
    names = [
        ("us:Assets", a), ("us:LiabilitiesAndStockholdersEquity", a + F.when(m == 1, 50).otherwise(0)), ("us:ProfitLoss", F.lit(70.0)), ("us:IncomeLossFromContinuingOperationsBeforeIncomeTaxes", F.lit(100.0)),
        ("us:IncomeTaxExpenseBenefit", F.when(m == 3, None).when(m == 2, 27.0).when(m == 1, -30.0).otherwise(30.0)), ("us:NetCashProvidedByUsedInOperatingActivities", F.lit(10.0)), ("us:NetCashProvidedByUsedInInvestingActivities", F.lit(-4.0)),
        ("us:NetCashProvidedByUsedInFinancingActivities", F.lit(1.0)), ("us:CashAndCashEquivalentsPeriodIncreaseDecrease", F.when(m == 0, 14.0).otherwise(7.0)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("concept"), v.cast("double").alias("value")) for i, (n, v) in enumerate(names)])
    facts_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(rows).alias("x")).select("k", "x.*")
    return filings.structural_checks(facts_, ["k"], 1.0, 10.0).withColumn("gap", F.round("gap", 4))


@query("SELECT p_partkey, p AS period, CASE p WHEN 'FY20' THEN p_retailprice ELSE p_size END AS value FROM part, (SELECT unnest(['FY20', '1Q20']) AS p) WHERE p_size % 5 <> 0 AND NOT (p = '1Q20' AND p_size % 2 = 0)")
def fn_p03_flatten(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    values = F.create_map(F.lit("FY20"), F.col("p_retailprice"), F.lit("1Q20"), F.when(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 4 == 0, float("nan"))).otherwise(F.col("p_size").cast("double")))
    rows = p.select("p_partkey", F.col("p_partkey").cast("string").alias("filename"), F.lit("is").alias("kind"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("concept"), F.col("p_name").alias("line"), values.alias("values_by_period"))
    return filings.flatten_workbook(rows).select(F.col("filename").cast("long").alias("p_partkey"), "period", "value")
