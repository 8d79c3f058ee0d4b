"""More queries over the tables of a data folder: research operators, merges, rankings and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import keep, rules, text as tx
from tallyframe.operators import entities, filings, research, search
from tallyframe.operators import statements as st
from tallyframe.operators import application as app
from tallyframe.plans.queries import query, r2, table
from tallyframe.sources import filings as src


@query("""WITH c AS (SELECT c_custkey, lower(regexp_replace(c_name, '#', ' ')) AS t, c_name FROM customer), r AS (SELECT *, CASE WHEN t = 'customer 00000001' THEN 100 WHEN starts_with(t, 'customer 00000001') THEN 85 WHEN instr(t, 'customer 00000001') > 0 THEN 70 - least(25, instr(t, 'customer 00000001') - 1)
 WHEN length(t) >= 8 AND instr('customer 00000001', t) > 0 THEN 72 - least(20, instr('customer 00000001', t) - 1) WHEN contains(t, 'customer') AND contains(t, '00000001') THEN 55 ELSE 0 END AS rank FROM c)
SELECT c_custkey, rank::INT AS rank FROM r WHERE rank > 0 ORDER BY rank DESC, length(c_name), c_custkey LIMIT 25""")
def join_11_search_companies(spark, sf_dir):
    return research.search_companies(table(spark, sf_dir, "customer"), "c_name", "Customer 00000001", 25, "c_custkey").select("c_custkey", "rank")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 3 <> 0 THEN 'low' WHEN c_custkey % 3 = 0 THEN 'high' WHEN c_custkey % 5 = 0 THEN 'medium' WHEN c_custkey % 7 = 0 THEN 'low' ELSE 'unknown' END AS confidence FROM customer""")
def fn_r09_confidence(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", research.confidence({"agent_only": k % 11 == 0, "lien": k % 3 == 0, "root_and_address": k % 5 == 0, "name_only": k % 7 == 0}).alias("confidence"))


@query("""WITH a AS (SELECT s_nationkey AS k, 0 AS source_rank, s_suppkey AS pos FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_rank, pos) = 1)
SELECT k, source_rank, pos FROM f ORDER BY source_rank, pos LIMIT 20""")
def agg_41_candidates(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("pos"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("pos"))
    return research.candidates([a, b], F.col("k"), 20, "pos")


@query("""WITH o AS (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier GROUP BY 1), n AS (SELECT c_nationkey AS k, min(c_name) AS name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, coalesce(segs, '') AS segs FROM o FULL JOIN n ON o.k = n.k""")
def join_28_fieldwise(spark, sf_dir):
    o = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name")).withColumn("segs", F.array().cast("array<string>"))
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name"), F.sort_array(F.collect_set("c_mktsegment")).alias("segs"))
    return research.merge_fieldwise(o, n, "k", ["name"], ["segs"]).withColumn("segs", F.array_join("segs", ","))


@query("""WITH p AS (SELECT n_nationkey AS k, n_regionkey % 3 AS s FROM nation), s AS (SELECT s_suppkey AS source, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_nationkey % 3 END AS state, s_suppkey % 7 AS priority FROM supplier)
SELECT k, source, min(priority) AS priority FROM p JOIN s ON state = p.s OR state IS NULL GROUP BY ALL""")
def join_26_recommend(spark, sf_dir):
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array((F.col("n_regionkey") % 3).cast("string")).alias("states"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.when(F.col("s_nationkey") >= 5, (F.col("s_nationkey") % 3).cast("string")).alias("state"), (F.col("s_suppkey") % 7).alias("priority"))
    return research.recommend_sources(p, s, "k")


@query("""WITH y AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS total, count(*)::DOUBLE AS n, max(o_totalprice) AS most FROM orders GROUP BY 1)
SELECT 'total' AS metric, string_agg(y::VARCHAR || '=' || round(total)::BIGINT::VARCHAR, ';' ORDER BY y) AS v FROM y UNION ALL SELECT 'n', string_agg(y::VARCHAR || '=' || n::BIGINT::VARCHAR, ';' ORDER BY y) FROM y UNION ALL SELECT 'most', string_agg(y::VARCHAR || '=' || round(most)::BIGINT::VARCHAR, ';' ORDER BY y) FROM y""")
def fn_p01_pivot_series(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("string").alias("y")).agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("most"))
    out = research.pivot_series(y, "y", ["total", "n", "most"])
    return out.select("metric", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]).cast("long").cast("string"))), ";").alias("v"))


@query("""SELECT o_orderkey, metric, value FROM (SELECT o_orderkey, o_totalprice AS total, o_custkey::DOUBLE AS cust FROM orders) UNPIVOT (value FOR metric IN (total, cust))""")
def fn_p02_unpivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("double").alias("cust"))
    return o.unpivot(["o_orderkey"], ["total", "cust"], "metric", "value")


@query("""SELECT user_id, event_type, max(value) AS body, max(event_id % 50) AS heading, string_agg(DISTINCT p, ',' ORDER BY p) AS paths, round(max(value) + max(event_id % 50), 2) AS total
FROM (SELECT *, 'p' || (event_id % 5)::VARCHAR AS p FROM events) GROUP BY ALL""")
def agg_43_merge_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("body"), (F.col("event_id") % 50).alias("heading"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("path"))
    out = research.merge_candidates(e, ["user_id", "event_type"], ["body", "heading"], "path")
    return out.withColumn("paths", F.array_join("paths", ",")).withColumn("total", r2(F.col("total")))


@query("""WITH r AS (SELECT user_id, event_id AS pos, (event_id % 4)::INT AS depth FROM events) SELECT a.user_id, a.pos, max(b.pos) AS parent FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.pos < a.pos AND b.depth < a.depth GROUP BY ALL""")
def agg_39_nearest_shallower(spark, sf_dir):
    r = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") % 4).cast("int").alias("depth"))
    return research.nearest_shallower(r, ["user_id"], "pos", "depth", 4).select("user_id", "pos", "parent")


@query("""WITH w AS (SELECT p_partkey AS want, p_brand AS period, p_type AS label FROM part), c AS (SELECT p_partkey AS pos, p_brand AS period, 'x ' || p_type || ' y' AS label, p_retailprice AS value FROM part)
SELECT want, w.period, arg_min(value, pos) AS value FROM w JOIN c ON w.period = c.period AND contains(lower(c.label), lower(w.label)) GROUP BY ALL""")
def join_23_grid_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cells = p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("period"), F.concat(F.lit("x "), "p_type", F.lit(" y")).alias("label"), F.col("p_retailprice").alias("value"))
    return research.grid_lookup(cells, p.select(F.col("p_partkey").alias("want"), F.col("p_brand").alias("period"), F.col("p_type").alias("label")))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, list_sort(list_distinct(list(o_orderpriority))) AS t FROM orders GROUP BY ALL), l AS (SELECT *, lag(t) OVER (PARTITION BY o_custkey ORDER BY y) AS b FROM y)
SELECT o_custkey, y::INT AS y, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(b, x))), ',') AS added FROM l WHERE b IS NOT NULL""")
def agg_34_topic_changes(spark, sf_dir):
    from tallyframe.operators.environment import topic_changes

    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.collect_set("o_orderpriority").alias("t"))
    return topic_changes(y, "o_custkey", "y", "t").select("o_custkey", "y", F.array_join("added", ",").alias("added"))


@query("""SELECT o_custkey, arg_max(o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 0 END * 1000 + ascii(o_orderpriority)) AS role FROM orders GROUP BY 1""")
def dedup_15_highest_role(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("role"))
    return entities.highest_role(o, ["o_custkey"], "role", {"1-URGENT": 3.0, "2-HIGH": 2.0, "3-MEDIUM": 0.0, "4-NOT SPECIFIED": 0.0, "5-LOW": 0.0})


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'id:' || (c_custkey % 50)::VARCHAR ELSE upper(regexp_replace(c_name, '#', ' ')) || '|' || upper(c_mktsegment) END AS k, count(*) AS n FROM customer GROUP BY 1""")
def dedup_17_master_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = entities.master_key(F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 50).cast("string")), F.col("c_name"), F.col("c_mktsegment"))
    return c.groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT regexp_replace(url, '\\?.*$', '') AS u, min(page_id) AS page_id FROM pages GROUP BY 1")
def dedup_20_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"\?.*$", "").alias("u"), "page_id")
    return keep.keep_first(p, ["u"], ["page_id"])


@query("""WITH s AS (SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY 1) SELECT o_custkey, best FROM s""")
def agg_12_best_candidate(spark, sf_dir):
    return keep.keep_last(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("best"), "o_totalprice"), ["o_custkey"], ["o_totalprice"]).drop("o_totalprice")


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS fy, arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::VARCHAR, 12, '0')) AS filing FROM orders GROUP BY ALL) SELECT o_custkey, fy::INT AS fy, filing FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY fy DESC) <= 3""")
def agg_16_last_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("fy"), F.col("o_orderkey").alias("filing"), "o_orderdate")
    newest = keep.keep_last(o, ["o_custkey", "fy"], ["o_orderdate", "filing"]).drop("o_orderdate")
    return app.retain_newest(newest, "o_custkey", [F.desc("fy")], 3)


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000")
def flt_18_join_18_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query()
def src_18_html_tables(spark, sf_dir):
    """The pages' lists as one-row tables beside their own tables."""
    pages = table(spark, sf_dir, "pages")
    html = F.regexp_replace(F.regexp_replace("html", "<ul>", "<table><tr>"), "</ul>", "</tr></table>")
    html = F.regexp_replace(F.regexp_replace(html, "<li>", "<td>"), "</li>", "</td>")
    return src.html_tables(pages.withColumn("html", html), "page_id", "html").withColumn("cells", F.to_json("cells"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey::VARCHAR AS a, o_orderstatus AS b FROM orders""")
def src_19_markdown_tables(spark, sf_dir):
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" |"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.concat(F.array(F.lit("text"), F.lit("|---|---|")), F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"])), "\n").alias("t"))
    out = src.markdown_tables(docs, "o_custkey", "t")
    return out.select("o_custkey", (F.col("line") - 1).cast("long").alias("line"), F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))) AS h FROM documents""")
def fn_s14_normal_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normal_space(F.col("text")), 256).alias("h"))




@query("""WITH k AS (SELECT p_brand AS row_id, p_size AS period, min(p_type) AS t FROM part GROUP BY ALL), v AS (SELECT k.row_id, k.period, arg_max(p_retailprice, p_partkey) AS value FROM k JOIN part ON p_brand = k.row_id AND p_size = k.period AND p_type = k.t GROUP BY ALL)
SELECT row_id, period, CASE WHEN period % 2 = 0 THEN -1.0 * period ELSE value END AS value, period % 2 <> 0 AS filled FROM v""")
def cov_06_reconcile_final(spark, sf_dir):
    """Cells of even periods have values, which stay; those of every third odd period are there without one."""
    p = table(spark, sf_dir, "part")
    facts = p.select(F.lit("s").alias("stmt"), F.concat_ws("|", "p_brand", "p_type").alias("concept"), F.col("p_size").alias("period"), F.col("p_partkey").alias("file"), F.col("p_retailprice").alias("value"))
    files = p.select(F.col("p_partkey").alias("file"), F.col("p_partkey").alias("recency"))
    entries = p.select(F.lit("s").alias("stmt"), F.concat_ws("|", "p_brand", "p_type").alias("concept"), F.col("p_brand").alias("row_id")).distinct()
    size = F.col("p_size")
    cells = p.select(F.lit("s").alias("stmt"), F.col("p_brand").alias("row_id"), size.alias("period"), F.when(size % 2 == 0, -1.0 * size).alias("value"), (size % 2 == 0).alias("even")).distinct().where((F.col("period") % 3 == 0) | F.col("even")).drop("even")
    return st.reconcile_final(cells, facts, entries, files).select("row_id", "period", "value", "filled")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) > 1 THEN p_type || ' · ' || p_size::VARCHAR ELSE p_type END AS label FROM part")
def win_16_number_repeats(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("label", F.col("p_type")).withColumn("s", F.col("p_size").cast("string"))
    return st.number_repeats(p, ["p_brand"], "label", "p_partkey", "s").select("p_partkey", "label")


@query("WITH l AS (SELECT p_brand, count(*) FILTER (p_size >= 28) AS n FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN l USING (p_brand) WHERE n < 3 OR p_size >= 28")
def flt_05_short_columns(spark, sf_dir):
    return st.drop_short_columns(table(spark, sf_dir, "part"), "p_brand", "p_size").select("p_partkey")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS s FROM customer), b AS (SELECT s_suppkey * 3 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '+' || s_name ELSE 's' END AS s FROM supplier)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN coalesce(length(b.s), -1) > coalesce(length(a.s), -1) THEN b.s ELSE a.s END AS snippet, concat_ws(' | ', CASE WHEN a.k IS NOT NULL THEN 'c' END, CASE WHEN b.k IS NOT NULL THEN 's' END) AS query FROM a FULL JOIN b ON a.k = b.k""")
def dedup_08_merge_hits(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("snippet"), F.lit("c").alias("query"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("+", "s_name", "s_name")).otherwise("s").alias("snippet"), F.lit("s").alias("query"))
    return search.merge_hits(a, b, "k")


@query("""SELECT o_orderkey, 'Q' || quarter(o_orderdate)::VARCHAR || ' ' || year(o_orderdate)::VARCHAR AS label FROM orders""")
def fn_d05_quarter_labels(spark, sf_dir):
    y, q, k = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    label = F.when(k == 0, F.concat(y, F.lit("Q"), q)).when(k == 1, F.concat(q, F.lit("Q "), y)).when(k == 2, F.concat(F.lit("q"), q, F.lit("-"), y)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.quarter_label_of(label).alias("label"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def fn_j03_json_in_text(spark, sf_dir):
    text = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nthat is all"))
    return table(spark, sf_dir, "events").select("event_id", tx.json_in_text(text, "k int")["k"].alias("k"))


@query("""SELECT p_partkey, '"' || p_name || '" OR ' || p_type AS q FROM part""".replace("p_type AS q", "CASE WHEN contains(p_type, ' ') THEN '\"' || p_type || '\"' ELSE p_type END AS q"))
def fn_s21_queries(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.any_of_query(F.array("p_name", "p_type")).alias("q"))


@query("SELECT c_custkey, c_name AS n1, c_mktsegment AS p1, 'B' AS n2, 'NY' AS p2 FROM customer")
def fn_s26_bracket_pairs(spark, sf_dir):
    pairs = tx.bracket_pairs(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit("), B (NY)")))
    at = lambda i, f: F.get(pairs, F.lit(i))[f]
    return table(spark, sf_dir, "customer").select("c_custkey", at(0, "name").alias("n1"), at(0, "place").alias("p1"), at(1, "name").alias("n2"), at(1, "place").alias("p2"))


@query("SELECT c_custkey, 2 AS n, c_mktsegment AS first FROM customer")
def fn_s27_markdown_sections(spark, sf_dir):
    s = tx.markdown_sections(F.concat(F.lit("# t\n## "), "c_mktsegment", F.lit("\ntext\n### x\n## End")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(s).alias("n"), F.get(s, F.lit(0)).alias("first"))


@query("""SELECT p_partkey, '$' || p_size::VARCHAR || ' million' AS amount, '5.25%' AS rate, CASE WHEN p_size % 2 = 0 THEN '2030' END AS maturity FROM part""")
def fn_s25_instrument_terms(spark, sf_dir):
    text = F.concat(F.lit("Notes of $"), F.col("p_size").cast("string"), F.lit(" million at 5.25% "), F.when(F.col("p_size") % 2 == 0, "due 2030").otherwise("open"))
    return table(spark, sf_dir, "part").withColumn("t", filings.instrument_terms(text)).select("p_partkey", "t.amount", "t.rate", "t.maturity")


@query("SELECT l_orderkey, l_returnflag, sum(CASE WHEN l_linenumber = 1 THEN 3 ELSE 1 END)::BIGINT AS score FROM lineitem GROUP BY ALL")
def agg_11_period_scores(spark, sf_dir):
    return filings.period_scores(table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_linenumber") - 1), ["l_orderkey", "l_returnflag"], "d")


@query("""SELECT o_custkey, arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def flt_22_latest_annual_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "10-k ").otherwise("10-K/A").alias("form"))
    return filings.latest_annual_report(o, "o_custkey", "form", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH v AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, n - a - r AS gap, abs(n - a - r) <= greatest(1, 0.02 * abs(n)) AS passed FROM v WHERE n IS NOT NULL AND a IS NOT NULL AND r IS NOT NULL""")
def val_04_06_relative_tolerance(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("role")).agg(F.sum("l_quantity").alias("value"))
    total = v.where("role = 'N'").select("l_orderkey", F.greatest(F.lit(1.0), 0.02 * F.abs("value")).alias("tolerance"))
    return st.check_equation(v, ["l_orderkey"], "role", "N", ["A", "R"]).join(total, "l_orderkey").select("l_orderkey", "gap", (F.abs("gap") <= F.col("tolerance")).alias("passed"))
