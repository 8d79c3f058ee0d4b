"""Queries of the engine's own operators over the tables of a data folder, and the SQL that gives the same rows.

Tables stand in for the data the operators were made for: lineitem and orders are statement facts (row = return flag,
concept = flag and status, period = quarter, source = order priority), events are posts and log lines, conversations
are chats, customers and suppliers are entities, parts are instruments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import keep, periods, rules, text as tx
from tallyframe.operators import application as app
from tallyframe.operators import corpus, entities, environment, filings, search
from tallyframe.operators import statements as st
from tallyframe.plans.compile import compile_statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r2(c: Column) -> Column:
    return F.round(c, 2)


# --- statement facts -------------------------------------------------------------------------------------------

def quarter_label(day: Column) -> Column:
    return periods.canonical(F.concat(F.lit("Q"), F.quarter(day).cast("string")), F.year(day))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of extended prices as facts; pos is the least order key."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(
        F.lit("income_statement").alias("stmt"), F.col("l_returnflag").alias("row_id"), F.concat("l_returnflag", "l_linestatus").alias("concept"),
        quarter_label(F.col("o_orderdate")).alias("period"), F.col("o_orderpriority").alias("file"),
    ).agg(r2(F.sum("l_extendedprice")).alias("value"), F.min("l_orderkey").alias("pos"))


FACTS = """
facts AS (
  SELECT 'income_statement' AS stmt, l_returnflag AS row_id, l_returnflag || l_linestatus AS concept,
    quarter(o_orderdate)::VARCHAR || 'Q' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') AS period, o_orderpriority AS file,
    round(sum(l_extendedprice), 2) AS value, min(l_orderkey) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), files AS (
  SELECT DISTINCT o_orderpriority AS file, substr(o_orderpriority, 1, 1)::INT AS recency FROM orders
)"""
BUCKETS = FACTS + """
, sums AS (
  SELECT stmt, row_id, period, file, count(DISTINCT concept) AS n_concepts, sum(value) AS total, count(value) AS n FROM facts GROUP BY ALL
), picked AS (
  SELECT stmt, row_id, period, file, n_concepts, total, arg_min(value, pos) AS first_value,
    arg_min(value, pos) FILTER (n > 1 AND abs(2 * value - total) <= 0.5) AS subtotal
  FROM facts JOIN sums USING (stmt, row_id, period, file) GROUP BY ALL
), buckets AS (
  SELECT stmt, row_id, period, file, n_concepts, CASE WHEN n_concepts = 1 THEN first_value ELSE coalesce(subtotal, total) END AS value,
    CASE WHEN n_concepts = 1 OR subtotal IS NOT NULL THEN 'reported' ELSE 'summed_within_file' END AS method
  FROM picked
)"""
CELLS = BUCKETS + """
, cells AS (
  SELECT stmt, row_id, period, arg_max(value, recency) AS value, arg_max(file, recency) AS file, arg_max(method, recency) AS method,
    count(DISTINCT value) AS n_values, count(DISTINCT value) > 1 AS is_conflict
  FROM buckets JOIN files USING (file) GROUP BY ALL
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file")).distinct().withColumn("recency", F.substring("file", 1, 1).cast("int"))


@query(f"WITH {BUCKETS} SELECT * REPLACE (round(value, 2) AS value) FROM buckets")
def agg_01_02_bucket_values(spark, sf_dir):
    return st.bucket_values(facts(spark, sf_dir)).withColumn("value", r2(F.col("value")))


@query(f"WITH {CELLS} SELECT * REPLACE (round(value, 2) AS value) FROM cells")
def agg_04_newest_value(spark, sf_dir):
    return st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir)).withColumn("value", r2(F.col("value")))


@query(f"""WITH {BUCKETS} SELECT stmt, row_id, period, string_agg(file || '=' || printf('%.2f', value), ';' ORDER BY recency DESC, file) AS all_values
FROM buckets JOIN files USING (file) WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def agg_05_conflicts(spark, sf_dir):
    out = st.conflicts(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir))
    shown = F.array_join(F.transform("values", lambda x: F.concat(x["file"], F.lit("="), F.format_string("%.2f", x["value"]))), ";")
    return out.select("stmt", "row_id", "period", shown.alias("all_values"))


@query("""SELECT filename, latest_fy, is_10k, row_number() OVER (ORDER BY latest_fy, filename) - 1 AS recency FROM (
  SELECT o_orderpriority AS filename, year(max(o_orderdate))::INT AS latest_fy, bool_or(o_orderstatus = 'F') AS is_10k FROM orders GROUP BY 1)""")
def agg_06_recency(spark, sf_dir):
    return st.recency(workbooks(spark, sf_dir))


def workbooks(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("filename")).agg(F.year(F.max("o_orderdate")).alias("latest_fy"), F.max(F.col("o_orderstatus") == "F").alias("is_10k"))


@query("""SELECT o_orderpriority AS filename, year(max(o_orderdate))::INT AS latest_fy, bool_or(o_orderstatus = 'F') AS is_10k
FROM orders GROUP BY 1 ORDER BY is_10k DESC, latest_fy DESC, filename LIMIT 1""")
def agg_07_pick_master(spark, sf_dir):
    return st.pick_master(workbooks(spark, sf_dir))


def with_years(cells: DataFrame) -> DataFrame:
    """cells and, for each row and year, the sum of its quarters as FY; the fourth quarter of odd rows is left out."""
    year = periods.fiscal_year(F.col("period"))
    full = cells.groupBy("stmt", "row_id", year.alias("y")).agg(r2(F.sum("value")).alias("value"))
    full = full.select("stmt", "row_id", periods.canonical(F.lit("FY"), F.col("y")).alias("period"), "value", F.lit("reported").alias("method"))
    return cells.where("period not like '4Q%'").select("stmt", "row_id", "period", "value", "method").unionByName(full)


YEARS = CELLS + """
, long AS (
  SELECT stmt, row_id, 2000 + right(period, 2)::INT AS year, max(value) FILTER (left(period, 2) = '1Q') AS q1, max(value) FILTER (left(period, 2) = '2Q') AS q2,
    max(value) FILTER (left(period, 2) = '3Q') AS q3, max(value) FILTER (left(period, 2) = '4Q') AS q4, round(sum(value), 2) AS fy
  FROM cells GROUP BY ALL
)"""


@query(f"""WITH {YEARS}, out AS (
  SELECT stmt, row_id, year, '1Q' || right(year::VARCHAR, 2) AS period, q1 AS value, 'kept' AS how FROM long
  UNION ALL SELECT stmt, row_id, year, '2Q' || right(year::VARCHAR, 2), q2, 'kept' FROM long
  UNION ALL SELECT stmt, row_id, year, '3Q' || right(year::VARCHAR, 2), q3, 'kept' FROM long
  UNION ALL SELECT stmt, row_id, year, '4Q' || right(year::VARCHAR, 2), fy - coalesce(q1, 0) - coalesce(q2, 0) - coalesce(q3, 0), 'derived' FROM long
  UNION ALL SELECT stmt, row_id, year, 'FY' || right(year::VARCHAR, 2), fy, 'kept' FROM long
) SELECT stmt, row_id, year, period, round(value, 2) + 0 AS value, how FROM out WHERE value IS NOT NULL""")
def win_03_derive_fourth_quarter(spark, sf_dir):
    cells = st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir))
    return st.derive(with_years(cells)).withColumn("value", r2(F.col("value")) + 0.0)


def as_statement(cells: DataFrame, stmt: str) -> DataFrame:
    return cells.withColumn("stmt", F.lit(stmt))


@query(f"""WITH {YEARS} SELECT row_id, year, '4Q' || right(year::VARCHAR, 2) AS period, round(fy, 2) AS value, 'copied_from_fy' AS how FROM long""")
def win_04_balance_fourth_quarter(spark, sf_dir):
    cells = with_years(st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir)))
    return st.derive(as_statement(cells, "balance_sheet")).where("how = 'copied_from_fy'").select("row_id", "year", "period", r2(F.col("value")).alias("value"), "how")


@query(f"""WITH {YEARS}, cum AS (SELECT row_id, year, q1, q1 + q2 AS m6, q1 + q2 + q3 AS m9, fy FROM long WHERE q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL)
SELECT row_id, year, '2Q' || right(year::VARCHAR, 2) AS period, round(m6 - q1, 2) AS value FROM cum
UNION ALL SELECT row_id, year, '3Q' || right(year::VARCHAR, 2), round(m9 - m6, 2) FROM cum
UNION ALL SELECT row_id, year, '4Q' || right(year::VARCHAR, 2), round(fy - m9, 2) FROM cum""")
def win_05_cash_flow_chain(spark, sf_dir):
    cells = st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir))
    year = periods.fiscal_year(F.col("period"))
    pick = lambda q: F.max(F.when(F.col("period").startswith(q), F.col("value"))).alias(q)
    w = cells.groupBy("row_id", year.alias("y")).agg(*[pick(q) for q in ("1Q", "2Q", "3Q")], r2(F.sum("value")).alias("FY")).dropna()
    spans = F.array(*[F.struct(periods.canonical(F.lit(k), F.col("y")).alias("period"), v.alias("value")) for k, v in (("Q1", F.col("1Q")), ("6M", F.col("1Q") + F.col("2Q")), ("9M", F.col("1Q") + F.col("2Q") + F.col("3Q")), ("FY", F.col("FY")))])
    long = w.select("row_id", F.explode(spans).alias("s")).select(F.lit("cash_flow").alias("stmt"), "row_id", "s.period", "s.value", F.lit("reported").alias("method"))
    return st.derive(long).where("how = 'derived'").select("row_id", "year", "period", r2(F.col("value")).alias("value"))


@query(f"""WITH {CELLS}, gaps AS (SELECT stmt, row_id, period, CASE WHEN file LIKE '5%' THEN NULL ELSE value END AS value FROM cells WHERE period NOT LIKE '1Q%'),
newest AS (SELECT stmt, row_id, period, arg_max(value, recency) AS newest FROM buckets JOIN files USING (file) WHERE value IS NOT NULL GROUP BY ALL)
SELECT stmt, row_id, period, round(coalesce(value, newest), 2) AS value, value IS NULL AS filled FROM gaps FULL JOIN newest USING (stmt, row_id, period)""")
def agg_08_fill_gaps(spark, sf_dir):
    buckets = st.bucket_values(facts(spark, sf_dir))
    cells = st.newest_value(buckets, files(spark, sf_dir)).where("period not like '1Q%'").withColumn("value", F.when(~F.col("file").like("5%"), F.col("value")))
    return st.fill_gaps(cells, buckets, files(spark, sf_dir)).withColumn("value", r2(F.col("value")))


@query(f"WITH {YEARS} SELECT stmt, row_id, year, true AS passed FROM long WHERE q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL")
def val_01_quarter_sum(spark, sf_dir):
    cells = st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir))
    done = st.derive(with_years(cells)).withColumn("method", F.col("how"))
    return st.check_quarter_sum(done).drop("gap")


@query(f"""WITH {CELLS}, w AS (SELECT period, max(value) FILTER (row_id = 'A') AS a, max(value) FILTER (row_id = 'N') AS n, max(value) FILTER (row_id = 'R') AS r FROM cells GROUP BY 1)
SELECT period, round(n - a - r, 2) AS gap, abs(n - a - r) <= 0.5 AS passed FROM w WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL""")
def val_02_equation(spark, sf_dir):
    cells = st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir))
    return st.check_equation(cells, ["period"], "row_id", "N", ["A", "R"]).withColumn("gap", r2(F.col("gap")))


@query("""WITH rows AS (SELECT p_brand, p_partkey, p_retailprice AS value, p_size >= 40 AS is_subtotal FROM part),
s AS (SELECT *, coalesce(sum(is_subtotal::INT) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section FROM rows),
g AS (SELECT p_brand, section, sum(value) FILTER (NOT is_subtotal) AS parts, max(value) FILTER (is_subtotal) AS subtotal FROM s GROUP BY ALL)
SELECT p_brand, section, round(coalesce(parts, 0), 2) AS parts, subtotal, abs(coalesce(parts, 0) - subtotal) <= 0.5 AS passed FROM g WHERE subtotal IS NOT NULL""")
def val_03_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("value"), (F.col("p_size") >= 40).alias("is_subtotal"))
    return st.check_sections(rows, ["p_brand"], "p_partkey").withColumn("parts", r2(F.col("parts")))


@query("""WITH m AS (SELECT p_type, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1)
SELECT p_partkey, part.p_type, CASE WHEN p_size % 5 = 0 THEN NULL ELSE brand END AS row_id,
 CASE WHEN p_size % 7 = 0 THEN 'blank_concept' WHEN p_size % 5 = 0 THEN 'no_mapping' END AS reason
FROM part JOIN m ON part.p_type = m.p_type""".replace("CASE WHEN p_size % 5 = 0 THEN NULL ELSE brand END", "CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN NULL ELSE brand END"))
def join_01_map_facts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    concept = F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 5 == 0, "unknown").otherwise(F.col("p_type"))
    given = part.select("p_partkey", "p_type", F.lit("s").alias("stmt"), concept.alias("concept"), F.col("p_name").alias("label"))
    entries = part.select(F.lit("s").alias("stmt"), F.col("p_type").alias("concept"), F.col("p_brand").alias("row_id"), F.col("p_partkey").alias("pos"))
    rows = part.select(F.lit("s").alias("stmt"), F.col("p_brand").alias("row_id"), F.col("p_brand").alias("display_label"), F.lit(0).alias("display_order")).distinct()
    return st.map_facts(given, entries, rows).select("p_partkey", "p_type", "row_id", "reason")


@query("""WITH m AS (SELECT lower(p_name) AS n, arg_min(p_partkey, p_partkey) AS row_id FROM part GROUP BY 1)
SELECT p_partkey, row_id, 'label' AS method FROM part JOIN m ON n = lower(p_name)""")
def join_03_04_match_concepts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    unmapped = part.select("p_partkey", F.lit("s").alias("stmt"), F.concat(F.lit("x:u"), F.col("p_partkey").cast("string")).alias("concept"), F.concat(F.lit("Total "), F.upper("p_name"), F.lit(" (net)")).alias("label"))
    rows = part.select(F.lit("s").alias("stmt"), F.concat(F.lit("y:m"), F.col("p_partkey").cast("string")).alias("concept"), F.col("p_name").alias("display_label"), F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("display_order"))
    return st.match_concepts(unmapped, rows).select("p_partkey", "row_id", "method")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 25 GROUP BY 1)")
def join_05_accept_external(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.where("p_size > 25").select(F.lit("s").alias("stmt"), F.col("p_brand").alias("row_id"))
    return st.accept_external(part.select(F.lit("s").alias("stmt"), F.col("p_brand").alias("row_id"), "p_partkey", "p_type"), rows).select("p_partkey", F.col("row_id").alias("p_brand"), "p_type")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM events""")
def join_06_nearest_preceding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("row_id", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return st.anchors(e, ["user_id"], "event_id").select("event_id", "user_id", "anchor")


@query("""WITH o AS (SELECT p_brand, p_partkey AS row_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::DOUBLE AS place, p_size FROM part),
old AS (SELECT * FROM o WHERE p_size <= 40), new AS (SELECT p_brand, row_id, (SELECT min(row_id) FROM old x WHERE x.p_brand = o.p_brand) AS anchor FROM o WHERE p_size > 40),
merged AS (SELECT p_brand, row_id, place FROM old UNION ALL
 SELECT n.p_brand, n.row_id, old.place + 0.001 * row_number() OVER (PARTITION BY n.p_brand ORDER BY n.row_id) FROM new n JOIN old ON old.row_id = n.anchor)
SELECT p_brand, row_id, row_number() OVER (PARTITION BY p_brand ORDER BY place, row_id) - 1 AS display_order FROM merged""")
def win_06_insert_after(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("row_id"), "p_size")
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("row_id")) - 1
    part = part.withColumn("display_order", at)
    old = part.where("p_size <= 40").drop("p_size")
    firsts = old.groupBy("p_brand").agg(F.min("row_id").alias("anchor"))
    new = part.where("p_size > 40").join(firsts, "p_brand").select("p_brand", "row_id", "anchor", F.col("row_id").alias("seq"))
    return st.insert_after(old, new, ["p_brand"])


@query("""WITH c AS (SELECT l_shipdate::DATE AS period, l_returnflag AS sheet, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL),
k AS (SELECT sheet, period FROM c WHERE n >= 0.5 * (SELECT max(n) FROM c d WHERE d.sheet = c.sheet))
SELECT sheet, period::VARCHAR AS period, count(*) AS n FROM (SELECT l_returnflag AS sheet, l_shipdate::DATE AS period FROM lineitem) JOIN k USING (sheet, period) GROUP BY ALL""")
def flt_01_sparse_columns(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.to_date("l_shipdate").alias("period"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("value"))
    return st.drop_sparse_columns(cells).groupBy("sheet", F.col("period").cast("string").alias("period")).agg(F.count("*").alias("n"))


@query(f"""WITH {CELLS}, y AS (SELECT 2000 + right(period, 2)::INT AS year FROM cells GROUP BY 1, left(period, 2)), f AS (SELECT year FROM y GROUP BY 1 HAVING count(*) = 4)
SELECT row_id, period, round(value, 2) AS value FROM cells WHERE 2000 + right(period, 2)::INT >= (SELECT greatest(1997, coalesce(min(year), 1997)) FROM f)""")
def flt_03_display_window(spark, sf_dir):
    cells = st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir))
    return st.display_from(cells, 1997).select("row_id", "period", r2(F.col("value")).alias("value"))


@query(f"""WITH {CELLS} SELECT stmt, row_id, round(max(value) FILTER (period = '1Q97'), 2) AS "1Q97", round(max(value) FILTER (period = '2Q97'), 2) AS "2Q97",
round(max(value) FILTER (period = '3Q97'), 2) AS "3Q97", round(max(value) FILTER (period = '4Q97'), 2) AS "4Q97" FROM cells GROUP BY ALL""")
def snk_02_statement_table(spark, sf_dir):
    labels = ["1Q97", "2Q97", "3Q97", "4Q97"]
    out = st.statement_table(st.newest_value(st.bucket_values(facts(spark, sf_dir)), files(spark, sf_dir)), labels)
    return out.select("stmt", "row_id", *[r2(F.col(c)).alias(c) for c in labels])


@query("""SELECT c.p_brand FROM (SELECT DISTINCT p_brand, p_type FROM part) c LEFT JOIN (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 3) k USING (p_brand, p_type) WHERE k.p_brand IS NULL""")
def cov_02_missing_concepts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return st.register_missing(part, part.where("p_size > 3"), ["p_brand", "p_type"]).select("p_brand")


@query("SELECT p_partkey FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size = 50 AND p_retailprice < 1000)")
def cov_07_prune_mapped(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("stmt", F.lit("s")).withColumn("concept", F.col("p_type"))
    return st.prune_mapped(part, part.where("p_size = 50 and p_retailprice < 1000")).select("p_partkey")


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'income' WHEN l_returnflag = 'A' THEN 'expense' ELSE 'net' END AS leg, l_quantity AS value, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, sum(value) AS single, arg_min(value, pos * 100 + value) FILTER (leg = 'net') AS net, sum(value) FILTER (leg = 'expense') AS e, sum(value) FILTER (leg = 'income') AS i FROM l GROUP BY 1)
SELECT l_orderkey, round(coalesce(net, CASE WHEN n = 1 THEN single END, coalesce(e, 0) - coalesce(i, 0)), 2) AS value, CASE WHEN net IS NULL AND n > 1 THEN 'interest_net' ELSE 'reported' END AS method FROM g""")
def agg_03_net_interest(spark, sf_dir):
    concept = F.when(F.col("l_returnflag") == "R", "us:InvestmentIncomeInterest").when(F.col("l_returnflag") == "A", "us:InterestExpenseDebt").otherwise("us:InterestIncomeExpenseNet")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", concept.alias("concept"), F.col("l_quantity").alias("value"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("pos"))
    return st.net_interest(rows, ["l_orderkey"]).withColumn("value", r2(F.col("value")))


@query(f"""WITH {CELLS} SELECT row_id, period, 2000 + right(period, 2)::INT AS year, round(value, 2) AS value, 'kept' AS how FROM cells""")
def plan_compile(spark, sf_dir):
    out = compile_statements(facts(spark, sf_dir), files(spark, sf_dir))
    return out.select("row_id", "period", "year", r2(F.col("value")).alias("value"), "how")


# --- periods and text ---------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, quarter(o_orderdate)::VARCHAR || 'Q' || right(year(o_orderdate)::VARCHAR, 2) AS label, 'Q' || quarter(o_orderdate)::VARCHAR AS kind,
(2000 + year(o_orderdate) % 100)::INT AS year, ((2000 + year(o_orderdate) % 100) * 100 + quarter(o_orderdate) - 1)::INT AS sort_key FROM orders""")
def fn_s01_topk_01_periods(spark, sf_dir):
    label = quarter_label(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), periods.period_type(label).alias("kind"), periods.fiscal_year(label).alias("year"), periods.sort_key(label).alias("sort_key"))


@query("""SELECT o_orderkey, strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d') AS ny_day, (date_diff('day', o_orderdate::DATE, last_day(o_orderdate::DATE)) + 1)::INT AS days,
CASE WHEN o_orderdate::DATE = last_day(o_orderdate::DATE) THEN last_day((o_orderdate::DATE - INTERVAL 3 MONTH)::DATE) ELSE (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE END::VARCHAR AS before FROM orders""")
def fn_d02_d04_days(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", periods.ny_date_key(F.col("o_orderdate")).alias("ny_day"), periods.duration_days(day, F.last_day(day)).alias("days"), periods.minus_months(day, 3).cast("string").alias("before"))


@query("""SELECT DISTINCT last_day(o_orderdate::DATE)::VARCHAR AS ends, CASE WHEN month(o_orderdate) % 3 = 0 THEN (month(o_orderdate) // 3)::VARCHAR || 'Q' || right(year(o_orderdate)::VARCHAR, 2) END AS label FROM orders""")
def fn_d03_fiscal_label(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").select(F.last_day(F.to_date("o_orderdate")).alias("ends")).distinct()
    start = F.date_add(F.add_months("ends", -3), 1)
    return ends.select(F.col("ends").cast("string").alias("ends"), periods.fiscal_label(start, F.col("ends"), 12, 31).alias("label"))


@query("""SELECT page_id, regexp_replace(url, '#.*$', '') AS base, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www\\.)?([^/?#:]+)', 1)) AS host,
(CASE WHEN url LIKE 'https://%' THEN 2 ELSE 0 END + CASE WHEN length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)) BETWEEN 6 AND 119 THEN 1 ELSE 0 END
 - CASE WHEN length(regexp_extract(url, '(\\?[^#]*)', 1)) > 60 THEN 1 ELSE 0 END)::INT AS quality FROM pages""")
def fn_s04_r16_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "#.*$", "").alias("base"), tx.host(u).alias("host"), tx.url_quality(u).alias("quality"))


@query("""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), q AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
 lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)', 1)) AS h, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)', 1), '/+$', '') AS path,
 array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND string_split(lower(x), '=')[1] NOT IN ('utm_source','utm_medium','utm_campaign','utm_content','utm_term','gclid','fbclid')), '&') AS kept FROM p)
SELECT page_id, scheme || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM q""")
def fn_s04_match_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.match_url(F.col("url")).alias("url"))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www\\.)?([^/?#:]+)', 1)), '(^|\\.)example\\.(com|net)$')")
def flt_10_allowed_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(tx.host_allowed(F.col("url"), ["example.com", "example.net"])).select("page_id")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS h, substr(sha256('d|' || doc_id::VARCHAR), 1, 16) AS short FROM documents""")
def fn_h01_dedup_11_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), tx.short_id(16, F.lit("d"), F.col("doc_id").cast("string")).alias("short"))


@query("SELECT c_custkey, least(c_custkey::VARCHAR, c_nationkey::VARCHAR) || ':' || greatest(c_custkey::VARCHAR, c_nationkey::VARCHAR) AS k FROM customer")
def fn_h03_pair_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.pair_key(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")).alias("k"))


@query("""SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT) AS h FROM customer""")
def fn_h02_hash31(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.hash31(F.col("c_name")).alias("h"))


@query("""SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) || ' HOLDINGS INC' AS normal, upper(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) AS root FROM customer""")
def fn_s09_entity_names(spark, sf_dir):
    name = F.concat("c_name", F.lit(" Holdings, Inc."))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.entity_name(name).alias("normal"), tx.entity_root(name).alias("root"))


@query("SELECT c_custkey, c_nationkey::VARCHAR || ' MAIN ST, STE ' || (c_custkey % 100)::VARCHAR AS address FROM customer")
def fn_s10_addresses(spark, sf_dir):
    a = F.concat(F.col("c_nationkey").cast("string"), F.lit("  Main Street,Suite "), (F.col("c_custkey") % 100).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.street_address(a).alias("address"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -p_retailprice WHEN p_size % 3 = 1 THEN p_retailprice ELSE NULL END AS value FROM part""")
def fn_m04_financial_numbers(spark, sf_dir):
    shown = F.format_number("p_retailprice", 2)
    cell = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("$ "), shown)).otherwise(F.lit("—"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.financial_number(cell).alias("value"))


@query("SELECT c_custkey, floor(c_acctbal + 0.5)::BIGINT AS r, least(100, greatest(0, c_acctbal)) AS c FROM customer")
def fn_m02_m03_round(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", keep.js_round(F.col("c_acctbal")).alias("r"), keep.clamp(F.col("c_acctbal"), 0.0, 100.0).alias("c"))


@query("""SELECT o_custkey, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::INT] AS m FROM orders GROUP BY 1""")
def agg_30_upper_median(spark, sf_dir):
    return keep.upper_medians(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice").withColumnRenamed("median", "m")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'debt_document' WHEN p_size % 4 = 1 THEN 'sec_filing' WHEN p_size % 4 = 2 THEN 'model_spreadsheet' ELSE 'other' END AS kind,
CASE p_size % 4 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 88 ELSE 50 END::DOUBLE AS priority FROM part""")
def fn_c05_topk_12_sources(spark, sf_dir):
    m = F.col("p_size") % 4
    name = F.when(m == 0, "x/Credit Agreement 1.pdf").when(m == 1, "10-K 2020.htm").when(m == 2, "lbo.xlsx").otherwise("zzz.bin")
    kind = corpus.classify_source(name)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), rules.lookup(kind, {k: float(v) for k, v in rules.SOURCE_PRIORITY.items()}, 50.0).alias("priority"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def fn_j01_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), "event_type").where("k is not null")


# --- corpus -------------------------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range(0, (CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE 1 + ceil((len(w) - 200) / 160.0) END)::BIGINT)) AS i FROM w)
SELECT doc_id, i::INT AS chunk_index, len(w[i * 160 + 1 : i * 160 + 200])::INT AS n_words, sha256(array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ')) AS chunk_hash FROM c""")
def win_13_word_chunks(spark, sf_dir):
    out = corpus.word_chunks(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "n_words", F.sha2("chunk", 256).alias("chunk_hash"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, (CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + ceil((length(text) - 1000) / 850.0) END)::BIGINT)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, i::INT AS chunk_index, (i * 850)::INT AS char_start, sha256(substr(text, i * 850 + 1, 1000)) AS chunk_hash FROM c""")
def win_14_char_chunks(spark, sf_dir):
    out = corpus.char_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "char_start", F.sha2("chunk", 256).alias("chunk_hash"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
c AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS nth FROM c)
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (length(k) >= 40 AND n >= 2 AND nth > 1)), '')) AS kept, count(*) FILTER (length(k) >= 40 AND n >= 2 AND nth > 1)::INT AS n_dropped FROM m GROUP BY 1""")
def agg_18_repeated_lines(spark, sf_dir):
    out = corpus.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 40, 2)
    return out.select("doc_id", F.sha2("text", 256).alias("kept"), "n_dropped")


@query("""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\n\\v\\f]*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12))), lambda p: p <> '')) AS p FROM documents),
n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id) AS pos FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(p) ORDER BY pos) AS nth FROM n)
SELECT documents.doc_id, coalesce(k, 0) AS n_paragraphs FROM documents LEFT JOIN (SELECT doc_id, count(*) AS k FROM f WHERE nth = 1 GROUP BY 1) USING (doc_id)""")
def dedup_10_paragraphs(spark, sf_dir):
    kept = corpus.dedupe_paragraphs(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(kept == "", 0).otherwise(F.size(tx.paragraphs(kept))).cast("long").alias("n_paragraphs"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{4,}'), 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM w WHERE word NOT IN ('with','from','were','been','being','have','does','will','would','could','should','might','this','that','these','those','they','their','than','then') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, word) AS nth FROM c) SELECT doc_id, string_agg(word, ' ' ORDER BY nth) AS tags FROM r WHERE nth <= 12 GROUP BY 1""")
def agg_19_frequent_words(spark, sf_dir):
    return corpus.frequent_words(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.array_join("tags", " ").alias("tags"))


_STOP = ", ".join(f"'{w}'" for w in tx.RANK_STOP)
_TOKENS = "list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://[^ \\t\\n\\r\\f\\v]+', ' ', 'g'), '[^a-z0-9$%.\\-+/ \\t\\n\\r\\f\\v]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN (" + _STOP + "))"


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), v AS (SELECT * FROM t WHERE len(w) > 0), n AS (SELECT count(*) AS n FROM v), d AS (SELECT unnest(list_distinct(w)) AS term FROM v)
SELECT term, count(*) AS df, round(greatest(0.2, ln(1 + (any_value(n) + 1) / (count(*) + 1))), 9) AS idf FROM d, n GROUP BY 1""")
def agg_17_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.array(tx.tokens(F.col("text"))), lambda w: F.size(w) > 0)).alias("w"))
    return corpus.inverse_frequencies(docs, "doc_id", "w").withColumn("idf", F.round("idf", 9))


_LABEL = _TOKENS.replace("coalesce(text, '')", "coalesce(source, '')")


@query(f"""WITH t AS (SELECT doc_id, source, n_chars, {_TOKENS} AS w, {_LABEL} AS label FROM documents), v AS (SELECT * FROM t WHERE len(w) > 0), n AS (SELECT count(*) AS n FROM v), items AS (SELECT * FROM benchmark WHERE item_id % 100 = 0),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(list_concat({_TOKENS}, ['src1', 'src2'])) AS term FROM items) GROUP BY ALL), x AS (SELECT doc_id, unnest(w) AS term FROM v), tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), idf AS (SELECT term, CASE WHEN df IS NULL THEN 0.2 ELSE greatest(0.2, ln(1 + (n + 1) / (df + 1))) END AS idf FROM (SELECT DISTINCT term FROM q) LEFT JOIN df USING (term), n),
s AS (SELECT item_id, doc_id, sum(ln(1 + tf) * idf * ln(1 + qf)) AS s FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY ALL), l AS (SELECT doc_id, unnest(label) AS term FROM v),
b AS (SELECT item_id, doc_id, sum(0.25 * idf) AS b FROM l JOIN q USING (term) JOIN idf USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round((coalesce(s, 0) + coalesce(b, 0)) * (1 + 12 / sqrt(80 + len(w))) * CASE WHEN n_chars > 2000 THEN 1.18 ELSE 1 END, 6) AS score FROM items CROSS JOIN v LEFT JOIN s USING (item_id, doc_id) LEFT JOIN b USING (item_id, doc_id)""")
def topk_05_rank_chunks(spark, sf_dir):
    """Every hundredth benchmark item against all documents; the source is the section label, long texts are boosted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"), tx.tokens(F.col("source")).alias("label"), F.when(F.col("n_chars") > 2000, 1.18).otherwise(1.0).alias("boost"))
    items = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select("item_id", F.concat(tx.tokens(F.col("text")), F.array(F.lit("src1"), F.lit("src2"))).alias("terms"))
    return corpus.rank_chunks(docs, items, "doc_id", "w", "item_id", "terms", "label", "boost").withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query, vec_id, coalesce(list_cosine_similarity(embedding::DOUBLE[], q), 0) AS c FROM embeddings, q)
SELECT query, vec_id, round(c, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 12) DESC, vec_id) <= 10""")
def topk_02_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return corpus.cosine_top_k(v, v.where("vec_id % 100 = 0"), 10, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS d, 1.0 AS unit FROM embeddings")
def fn_m01_unit_vectors(spark, sf_dir):
    e = F.col("embedding")
    u = corpus.unit(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(corpus.dot(e, e), 4).alias("d"), F.round(corpus.dot(u, u), 6).alias("unit"))


@query("""WITH r AS (SELECT *, sum(n_chars + 120) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS nth FROM documents)
SELECT doc_id, used FROM r WHERE used <= 240000 OR nth = 1""")
def topk_03_pack_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return corpus.pack_budget(docs, "n_chars", "doc_id", "n_chars", 240000).select("doc_id", "used")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS g FROM documents), r AS (SELECT *, sum(n_chars + 120) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS nth FROM c WHERE g <= 3)
SELECT doc_id, used FROM r WHERE used <= 240000 OR nth = 1""")
def topk_04_win_18_capped_pack(spark, sf_dir):
    docs = corpus.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 3)
    return corpus.pack_budget(docs, "n_chars", "doc_id", "n_chars", 240000).select("doc_id", "used")


@query("""WITH b AS (SELECT conv_id, turn, least(length(text), 300) AS c, coalesce(sum(least(length(text), 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, least(c, 700 - before)::INT AS take FROM b WHERE (least(c, 700 - before) = c AND c > 0) OR least(c, 700 - before) >= 40""")
def topk_06_14_pack_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return corpus.pack_parts(parts, ["conv_id"], ["turn"], "len", 300, 700, 40).select("conv_id", "turn", F.col("take").cast("int").alias("take"))


@query("SELECT conv_id, sha256(string_agg(h, chr(10) ORDER BY h)) AS fingerprint FROM (SELECT conv_id, sha256(coalesce(text, '')) AS h FROM conversations) GROUP BY 1")
def agg_37_fingerprint(spark, sf_dir):
    return corpus.fingerprint(table(spark, sf_dir, "conversations"), ["conv_id"], "text")


@query("WITH s AS (SELECT source, count(*) AS w FROM documents GROUP BY 1) SELECT source, greatest(120, floor(4000 * w / (SELECT sum(w) FROM s) + 0.5))::INT AS words FROM s")
def agg_33_allocate(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return corpus.allocate(parts, "w", 4000).select("source", "words")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' on ' || (DATE '2020-01-01' + (doc_id % 900)::INT) || ', Q' || (doc_id % 4 + 1) || ' 2021 and FY' || (10 + doc_id % 80) || '; $' || (doc_id % 7) || '.5 million, ' || doc_id || ',500 or ' || (doc_id % 50) || '%x on Mar. ' || (doc_id % 28 + 1) || ', 2020, 3/4/21' AS t FROM documents),
f AS (SELECT doc_id, list_transform(list_concat(regexp_extract_all(t, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'), regexp_extract_all(t, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{4}\b'), regexp_extract_all(t, '(?i)\bQ[1-4]\s*''?[0-9]{2,4}\b'), regexp_extract_all(t, '(?i)\bFY\s*''?[0-9]{2,4}\b'),
 regexp_extract_all(t, '\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b'), regexp_extract_all(t, '\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b'), regexp_extract_all(t, '(?i)\$\s*[0-9]+(?:\.[0-9]+)?(?:\s*(?:million|billion|M|B))?\b'), regexp_extract_all(t, '\b[0-9]+(?:\.[0-9]+)?\s*%\b')), lambda x: trim(x)) AS l FROM d)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:24], '|') AS found FROM f""".replace("\\\\", "\\"))
def fn_s17_dates(spark, sf_dir):
    """All eight kinds in whole texts, to which each document's own dates and numbers are added."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    s = lambda c: c.cast("string")
    day = s(F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")))
    more = F.concat(F.lit(" on "), day, F.lit(", Q"), s(k % 4 + 1), F.lit(" 2021 and FY"), s(10 + k % 80), F.lit("; $"), s(k % 7), F.lit(".5 million, "), s(k), F.lit(",500 or "), s(k % 50), F.lit("%x on Mar. "), s(k % 28 + 1), F.lit(", 2020, 3/4/21"))
    return d.select("doc_id", F.array_join(tx.numbers_and_dates(F.concat(F.coalesce("text", F.lit("")), more)), "|").alias("found"))


@query()
def fn_s16_s18_win_15_enrich(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    windows = corpus.keyword_windows(docs, "doc_id", "text", r"(?i)license|secret|the").groupBy("doc_id").agg(F.count("*").alias("n_windows"))
    facts_ = docs.select("doc_id", tx.summary(F.col("text")).alias("summary"), F.array_join(tx.capital_phrases(F.col("text")), "; ").alias("phrases"), F.size(tx.links(F.col("text"))).alias("n_links"))
    return facts_.join(windows, "doc_id", "left")


@query()
def fn_s13_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


# --- search -------------------------------------------------------------------------------------------------------

def hits(spark, sf_dir) -> DataFrame:
    """Events as articles: the title from type and hour, the provider from the user."""
    e = table(spark, sf_dir, "events")
    title = F.concat_ws(" ", F.col("event_type"), F.lit("report"), F.get_json_object("props", "$.k"), F.lit("of"), F.date_format("ts", "yyyy MM dd"))
    return e.select(F.col("event_id").alias("id"), title.alias("title"), F.concat(F.lit("https://n"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/"), F.lower(F.col("event_type")), F.lit("?id="), F.get_json_object("props", "$.k")).alias("url"),
                    F.concat("event_type", F.lit(" "), F.col("props")).alias("summary"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"), F.col("value").alias("score"), F.col("ts").alias("at"), (F.col("user_id") % 5).cast("int").alias("priority"), "event_type")


@query()
def dedup_01_greedy_clusters(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("words", tx.word_set(F.col("title")))
    return search.greedy_clusters(rows, "id", "url", "words", "at", [F.col("priority"), -F.unix_micros(F.col("at").cast("timestamp"))])


@query()
def dedup_02_merge_clusters(spark, sf_dir):
    rows = hits(spark, sf_dir)
    clusters = search.greedy_clusters(rows.withColumn("words", tx.word_set(F.col("title"))), "id", "url", "words", "at", [F.col("priority"), -F.unix_micros(F.col("at").cast("timestamp"))])
    return search.merge_clusters(rows.join(clusters, "id"), "cluster", ["priority", "at", "id"])


@query("""WITH h AS (SELECT event_id AS id, user_id, event_type, value, ts FROM events), a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, id) = 1)
SELECT user_id, event_type, id, value FROM a QUALIFY row_number() OVER (PARTITION BY event_type, floor(value * 10) ORDER BY value DESC, id) = 1""")
def dedup_04_two_pass_best(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("u"), F.floor(F.col("value") * 10).alias("b"))
    return search.two_pass_best(h, "u", ["event_type", "b"], [-F.col("value"), F.col("id")]).select("user_id", "event_type", "id", "value")


@query("""SELECT user_id, arg_max(event_id, value * 1e9 - event_id) AS event_id, max(value) AS value, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) AS n_hits FROM events GROUP BY 1""")
def dedup_05_keyed_merge(spark, sf_dir):
    h = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.array("event_type").alias("types"))
    return search.keyed_merge(h, "user_id", "value", ["types"], "event_id").select("user_id", "event_id", "value", F.array_join("types", ",").alias("types"), "n_hits")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def dedup_06_keep_first(spark, sf_dir):
    return keep.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("""WITH k AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate, lower(o_orderstatus || ' ' || o_custkey::VARCHAR) AS t FROM orders)
SELECT o_orderkey, t FROM k QUALIFY row_number() OVER (PARTITION BY t ORDER BY substr(o_orderpriority, 1, 1)::INT, o_orderdate DESC, o_orderkey DESC) = 1""")
def dedup_09_headlines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderstatus", F.col("o_custkey").cast("string")).alias("title"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), "o_orderdate")
    return search.headline_dedupe(o, "title", "rank", "o_orderdate", "o_orderkey").select("o_orderkey", tx.match_title(F.col("title")).alias("t"))


_AGE = "CASE WHEN a < 2 THEN 22 WHEN a < 7 THEN 16 WHEN a < 30 THEN 10 WHEN a < 180 THEN 4 ELSE 0 END"


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' AND p_name LIKE '%red%' THEN 'mixed' WHEN p_name LIKE '%widget%' THEN 'company' WHEN p_name LIKE '%red%' THEN 'ticker' ELSE 'none' END AS how FROM part")
def flt_12_mentions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", search.mentions(F.col("p_name"), "red", "Widget").alias("how"))


# --- entities and registries -----------------------------------------------------------------------------------------

@query("""SELECT c_nationkey, bool_or(c_acctbal > 9000) AS rich, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, arg_min(c_name, c_custkey) AS name, max(c_acctbal) AS score, count(DISTINCT c_custkey % 3) AS n_layers FROM customer GROUP BY 1""")
def agg_25_merge_layers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") > 9000).alias("rich"), F.col("c_mktsegment").alias("segments"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 3).alias("layer"), "c_custkey", "c_name")
    firsts = rows.groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("name"))
    out = entities.merge_layers(rows, "c_nationkey", "layer", ["rich"], ["segments"], [], "score")
    return out.join(firsts, "c_nationkey").select("c_nationkey", "rich", F.array_join("segments", ",").alias("segments"), "name", "score", "n_layers")


@query("""SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) FILTER (o_orderpriority LIKE '1%') AS borrower, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) FILTER (o_orderpriority LIKE '2%') AS guarantor,
arg_max(o_orderpriority, length(o_orderpriority)::VARCHAR || lpad('', 0) || o_orderpriority) AS display_name, count(DISTINCT o_orderkey) AS n_docs FROM orders GROUP BY 1""".replace("length(o_orderpriority)::VARCHAR || lpad('', 0) || o_orderpriority", "lpad(length(o_orderpriority)::VARCHAR, 4, '0') || o_orderpriority"))
def agg_26_role_matrix(spark, sf_dir):
    role = F.when(F.col("o_orderpriority").like("1%"), "borrower").when(F.col("o_orderpriority").like("2%"), "guarantor")
    state = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "unclear").otherwise("no")
    rows = table(spark, sf_dir, "orders").select("o_custkey", role.alias("role"), state.alias("state"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("doc"))
    return entities.role_matrix(rows, "o_custkey", "role", "state", "name", "doc", ["borrower", "guarantor"])


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), s AS (SELECT o_custkey, least(100, sum(CASE left(o_orderpriority, 1) WHEN '1' THEN 40 WHEN '2' THEN 35 WHEN '3' THEN 20 ELSE 0 END)) AS score FROM d GROUP BY 1)
SELECT o_custkey, score::DOUBLE AS score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'minimal' END AS tier FROM s""")
def agg_27_role_score(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("role"))
    return entities.role_score(rows, "o_custkey", "role", {"1": 40.0, "2": 35.0, "3": 20.0})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def join_15_missing_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", F.concat(F.lit("Unit "), F.col("c_custkey").cast("string"), F.lit(" L.L.C.")))
    s = table(spark, sf_dir, "supplier").withColumn("n", F.concat(F.lit("UNIT "), F.col("s_suppkey").cast("string"), F.lit(", l.l.c.")))
    return entities.missing_from(c, s, "n", "n").select("c_custkey")


@query("SELECT c_custkey, c_custkey IN (SELECT s_suppkey FROM supplier) AS listed FROM customer")
def join_15_flag_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", F.concat(F.lit("Unit "), F.col("c_custkey").cast("string")))
    s = table(spark, sf_dir, "supplier").withColumn("n", F.concat(F.lit("UNIT  "), F.col("s_suppkey").cast("string")))
    return entities.flag_members(c, s, "n", "n", "listed").select("c_custkey", "listed")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def join_16_same_root(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", F.concat(F.lit("Unit "), F.col("c_custkey").cast("string"), F.lit(" Holdings LLC")))
    s = table(spark, sf_dir, "supplier").withColumn("n", F.concat(F.lit("Unit "), F.col("s_suppkey").cast("string"), F.lit(" Corp.")))
    return entities.same_root(c, s, "n", "n").select("c_custkey")


@query("SELECT name, state, registry, lower(name || '|' || state || '|' || registry) AS task_key FROM (SELECT DISTINCT trim(s_name) AS name FROM supplier), (SELECT unnest(['DE', 'NY', 'TX']) AS state), (SELECT unnest(['sos', 'ucc']) AS registry)")
def join_17_search_tasks(spark, sf_dir):
    return entities.search_tasks(table(spark, sf_dir, "supplier"), "s_name", ["DE", "NY", "TX"], ["sos", "ucc"])


@query("SELECT s_suppkey, upper(regexp_replace(s_name, '#', ' ')) || ' CORP' AS v1, upper(regexp_replace(s_name, '#', ' ')) AS v2 FROM supplier")
def fn_s22_name_variants(spark, sf_dir):
    v = entities.name_variants(F.concat("s_name", F.lit(" Corp.")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(v, F.lit(0)).alias("v1"), F.get(v, F.lit(1)).alias("v2"))


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, CASE WHEN c_custkey IS NOT NULL AND s_suppkey IS NOT NULL THEN 'merged' WHEN c_custkey IS NOT NULL THEN 'a' ELSE 'b' END AS source
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 7""".replace("coalesce(c_custkey, s_suppkey) AS id", "coalesce(c_custkey, s_suppkey * 7) AS id"))
def join_13_registries(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("id"), F.col("s_name").alias("name"))
    return environment.merge_registries(a, b, "id", ["name"])


@query("""WITH u AS (SELECT o_custkey AS k, max(o_totalprice) AS score, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS c, bool_or(o_orderpriority LIKE '1%') AS cf FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
m AS (SELECT o_custkey AS k, max(o_totalprice) + 1 AS score FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)
SELECT coalesce(u.k, m.k) AS k, CASE WHEN m.k IS NULL THEN 'kept' WHEN u.k IS NULL THEN 'created' WHEN cf THEN 'skipped' ELSE 'updated' END AS action, round(CASE WHEN m.k IS NULL OR cf THEN u.score ELSE greatest(u.score, m.score) END, 2) AS score FROM u FULL JOIN m ON u.k = m.k""".replace("OR cf THEN u.score", "OR coalesce(cf, false) THEN u.score"))
def join_27_merge_universe(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    u = o.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("score"), F.collect_set("o_orderstatus").alias("categories"), F.max(F.col("o_orderpriority").like("1%")).alias("confirmed"))
    m = o.where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_totalprice") + 1).alias("score"), F.collect_set("o_orderpriority").alias("categories"))
    return entities.merge_universe(u, m, "k").select("k", "action", r2(F.col("score")).alias("score"))


@query("""SELECT c_custkey, 'negative_balance' AS rule, 'high' AS severity FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'no_segment', 'low' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def agg_38_issues(spark, sf_dir):
    return entities.issues(table(spark, sf_dir, "customer"), "c_custkey", [("negative_balance", "high", F.col("c_acctbal") < 0), ("no_segment", "low", F.col("c_mktsegment") == "BUILDING")])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_23_histogram(spark, sf_dir):
    return environment.histogram(table(spark, sf_dir, "events"), "event_type")


@query("""WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(value) AS score, list_sort(list_distinct(list(event_type))) AS ids FROM events GROUP BY ALL), l AS (SELECT *, lag(score) OVER w AS ps, lag(ids) OVER w AS pi FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, round(score - ps, 2) AS change, coalesce(array_to_string(list_sort(list_filter(ids, lambda x: NOT list_contains(pi, x))), ','), '') AS new_ids, abs(score - ps) >= 12 OR len(list_filter(ids, lambda x: NOT list_contains(pi, x))) > 0 AS alert FROM l WHERE pi IS NOT NULL""")
def win_17_snapshot_changes(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("score"), F.sort_array(F.collect_set("event_type")).alias("ids"))
    out = environment.snapshot_changes(s, "user_id", "day", "score", "ids")
    return out.select("user_id", "day", r2(F.col("change")).alias("change"), F.array_join("new_ids", ",").alias("new_ids"), "alert")


@query("SELECT event_type, arg_max(event_id, value * 1e9 - event_id) AS event_id, max(value) AS value FROM events GROUP BY 1 ORDER BY value DESC, event_type LIMIT 12")
def topk_11_hotspots(spark, sf_dir):
    return environment.hotspots(table(spark, sf_dir, "events"), "event_type", "event_id", "value")


# --- filings ------------------------------------------------------------------------------------------------------

@query("SELECT l_partkey, l_suppkey, arg_max(l_extendedprice, strftime(l_shipdate, '%Y%m%d') || l_returnflag || lpad((l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0')) AS value FROM lineitem GROUP BY ALL")
def agg_09_latest_filed(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", F.col("l_extendedprice").alias("value"))
    return filings.latest_filed(cells, ["l_partkey", "l_suppkey"], "l_shipdate", "l_returnflag", "value").drop("l_shipdate")


@query("""WITH f AS (SELECT l_orderkey, l_quantity AS v, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END * 100 + l_linenumber % 3 AS r FROM lineitem), b AS (SELECT l_orderkey, min(r) AS r FROM f GROUP BY 1),
s AS (SELECT l_orderkey, list_sort(list_distinct(list(v))) AS vs FROM f JOIN b USING (l_orderkey, r) GROUP BY 1) SELECT l_orderkey, vs[(len(vs) // 2 + 1)::INT] AS value, len(vs)::INT AS n_values FROM s""")
def agg_10_resolve_duplicates(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("NetIncomeLoss").alias("concept"), F.col("l_quantity").alias("value"), F.when(F.col("l_linestatus") == "O", "USD").otherwise("EUR").alias("unit"), (F.col("l_linenumber") % 3).alias("dims"))
    return filings.resolve_duplicates(f, ["l_orderkey"], "concept", "value", "unit", "dims").drop("concept")


@query("""WITH v AS (SELECT l_orderkey, l_returnflag AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey, max(v) FILTER (c = 'N') AS n, max(v) FILTER (c = 'A') AS a, max(v) FILTER (c = 'R') AS r FROM v GROUP BY 1)
SELECT l_orderkey, 'N' AS parent, n AS pv, a - r AS total, abs(n - (a - r)) <= greatest(20, 0.002 * abs(n)) AS passed FROM w WHERE n IS NOT NULL AND a IS NOT NULL AND r IS NOT NULL""")
def join_09_val_05_rollups(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("concept")).agg(F.sum("l_quantity").alias("value"))
    arcs = spark.createDataFrame([("N", "A", 1.0), ("N", "R", -1.0)], "parent string, child string, weight double")
    return filings.rollups(arcs, v, ["l_orderkey"], 20.0)


@query("""SELECT l_orderkey, l_linenumber, p_type, CASE WHEN s_acctbal > 5000 THEN s_name END AS unit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def join_07_facts_by_context(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("context_ref"), F.col("l_suppkey").alias("unit_ref"))
    ctx = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("context_ref"), "p_type", F.lit(0).alias("dim_count"))
    units = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("unit_ref"), F.col("s_name").alias("unit"))
    return filings.facts_by_context(li, ctx, units).select("l_orderkey", "l_linenumber", "p_type", "unit")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS amendment_no,
first_value(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM orders""")
def win_08_amendments(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("amends"))
    return filings.amendment_chain(o, "o_custkey", "o_orderdate", "amends", "o_orderkey").select("o_orderkey", "o_custkey", F.col("amendment_no").cast("long").alias("amendment_no"), "base")


_RUNS = """h AS (SELECT user_id, event_id, (value)::INT % 30 AS num FROM (SELECT user_id, event_id, floor(value) AS value FROM events)), l AS (SELECT *, lag(num) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM h),
r AS (SELECT *, sum(coalesce((p - num >= 5 OR (p >= 10 AND num <= 5))::INT, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l)"""


def headings(spark, sf_dir):
    h = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 30).cast("int").alias("num"))
    return filings.heading_runs(h, "user_id", "event_id", "num")


@query(f"WITH {_RUNS} SELECT user_id, event_id, num, run FROM r")
def win_09_heading_runs(spark, sf_dir):
    return headings(spark, sf_dir)


@query(f"""WITH {_RUNS}, g AS (SELECT *, event_id - lag(event_id) OVER w AS gap, (num > lag(num) OVER w)::INT AS up FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY event_id))
SELECT user_id, run, count(*) AS n, coalesce(sum(up), 0)::BIGINT AS n_up, list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(gap) // 2 + 1)::INT] AS median_gap FROM g GROUP BY ALL""")
def win_10_run_scores(spark, sf_dir):
    return filings.run_scores(headings(spark, sf_dir), "user_id", "event_id", "num")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000) AS segment_end FROM conversations")
def win_11_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1000).cast("long").alias("ends"))
    return filings.segments(c, "conv_id", "turn", "ends").drop("ends")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def win_12_carry_heading(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("h"))
    return filings.carry_heading(c, "conv_id", "turn", "h").select("conv_id", "turn", "section")


@query()
def join_10_reconcile_footnotes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    notes = part.where("p_size >= 48").select(F.col("p_partkey").alias("note"), F.concat("p_name", F.lit(" "), "p_type").alias("description"), F.col("p_retailprice").cast("string").alias("amount"), F.lit("2030-01-01").alias("maturity"))
    inst = part.select(F.col("p_partkey").alias("pos"), F.concat("p_brand", F.lit(" "), "p_name", F.lit(" "), "p_type").alias("name"), F.col("p_retailprice").cast("string").alias("principal"), F.lit("2030").alias("due"))
    return filings.reconcile_footnotes(notes, inst)


@query("""WITH c AS (SELECT o_custkey, o_orderkey, (epoch(o_orderdate) / 86400)::BIGINT % 400 AS d FROM orders) SELECT o_custkey, arg_max(o_orderkey, CASE WHEN d BETWEEN 350 AND 380 THEN 3 WHEN d BETWEEN 300 AND 349 THEN 2 WHEN d BETWEEN 85 AND 100 THEN 1 ELSE 0 END * 1e9 - o_orderkey) AS idx FROM c GROUP BY 1""")
def agg_14_annual_column(spark, sf_dir):
    days = F.floor(F.unix_timestamp("o_orderdate") / 86400) % 400
    return filings.annual_column(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), days.alias("days")), ["o_custkey"])


@query("""WITH RECURSIVE e AS (SELECT o_orderkey // 10 AS parent, o_orderkey AS child FROM orders WHERE o_orderkey <> o_orderkey // 10), r AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)),
t AS (SELECT node, 0 AS depth FROM r UNION ALL SELECT child, depth + 1 FROM t JOIN e ON e.parent = t.node) SELECT node, depth FROM t""")
def fn_g01_tree(spark, sf_dir):
    """All orders as trees: an order hangs below the one whose key is its own without the last digit."""
    o = table(spark, sf_dir, "orders")
    arcs = o.select(F.lit("r").alias("role"), F.floor(F.col("o_orderkey") / 10).alias("parent"), F.col("o_orderkey").alias("child"), F.col("o_orderkey").alias("ord")).where("parent <> child")
    roots = arcs.select("role", F.col("parent").alias("node")).distinct().join(arcs.select(F.col("child").alias("node")), "node", "left_anti").select("role", "node")
    return filings.tree_rows(arcs, roots).select("node", "depth")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE >= DATE '2002-01-01' - INTERVAL 3 YEAR")
def flt_07_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("form", F.col("o_orderpriority")).withColumn("filed", F.to_date("o_orderdate"))
    return filings.filter_forms(o, ["1-URGENT", "2-HIGH"], "filed", "2002-01-01", 3).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS part FROM lineitem")
def fn_a02_columnar_rows(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    wide = each.select("l_orderkey", F.col("x.l_partkey").alias("part"), F.col("x.l_linenumber").alias("line"))
    return filings.columnar_rows(wide, ["part", "line"], "l_orderkey").select("l_orderkey", F.col("pos").cast("long").alias("pos"), "part")


# --- application --------------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT user_id, event_type, value, event_id, 0 AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, value + 1, event_id, 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, event_id, round(value, 2) AS value FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, event_id DESC) = 1""")
def snk_05_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    out = app.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1), ["user_id", "event_type"], "event_id")
    return out.withColumn("value", r2(F.col("value")))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events QUALIFY dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) <= 5) SELECT event_id FROM events JOIN d ON d.user_id = events.user_id AND d.day = ts::DATE""")
def snk_10_retain_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return app.retain_last_keys(e, "user_id", "day", 5).select("event_id")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def snk_10_retain_newest(spark, sf_dir):
    return app.retain_newest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("event_id")


@query("""SELECT owner, sum(bytes)::BIGINT AS bytes FROM (SELECT user_id AS owner, coalesce(sum(octet_length(encode(props))), 0) AS bytes FROM events GROUP BY 1 UNION ALL SELECT conv_id, coalesce(sum(octet_length(encode(text))), 0) FROM conversations GROUP BY 1) GROUP BY 1""")
def agg_20_storage(spark, sf_dir):
    return app.storage_bytes([(table(spark, sf_dir, "events"), "user_id", "props"), (table(spark, sf_dir, "conversations"), "conv_id", "text")])


@query("""WITH u AS (SELECT user_id AS owner, sum(octet_length(encode(props))) AS bytes FROM events GROUP BY 1) SELECT c_custkey AS owner, (coalesce(bytes, 0) + c_acctbal::BIGINT)::BIGINT AS total, coalesce(bytes, 0) + c_acctbal::BIGINT <= 5000 OR c_acctbal::BIGINT <= 0 AS allowed FROM customer LEFT JOIN u ON owner = c_custkey""".replace("c_acctbal::BIGINT", "floor(c_acctbal)::BIGINT"))
def snk_13_quota(spark, sf_dir):
    used = app.storage_bytes([(table(spark, sf_dir, "events"), "user_id", "props")])
    delta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.floor("c_acctbal").alias("delta"))
    return app.within_quota(used, delta, 5000)


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def join_21_latest_per_group(spark, sf_dir):
    return app.latest_per_group(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


@query("SELECT a.event_id, b.event_type AS parent_event_type FROM events a LEFT JOIN events b ON a.event_id - 7 = b.event_id")
def join_20_replies(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("reply_to", F.col("event_id") - 7)
    return app.replies(e, "event_id", "reply_to", ["event_type"]).select("event_id", "parent_event_type")


@query("SELECT event_id FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 50")
def topk_09_page(spark, sf_dir):
    return app.page_before(table(spark, sf_dir, "events"), "event_id", F.lit(5000), 50).select("event_id")


@query("WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 200) SELECT c_custkey FROM f WHERE lower(c_mktsegment) LIKE '%auto%' OR lower(c_name) LIKE '%auto%'")
def topk_15_search_users(spark, sf_dir):
    return app.search_users(table(spark, sf_dir, "customer"), "auto", ["c_mktsegment", "c_name"], ["c_custkey"], 200).select("c_custkey")


@query()
def snk_11_next_fit(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return app.next_fit(d, "conv_id", "turn", "size", 1000)


@query("SELECT x AS event_type, (SELECT count(*) FROM events e WHERE e.event_type = x) AS n FROM (SELECT unnest(['click', 'purchase', 'refund', 'none']) AS x)")
def agg_24_zero_filled(spark, sf_dir):
    return app.counts_with_zeros(table(spark, sf_dir, "events"), "event_type", ["click", "purchase", "refund", "none"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def dedup_12_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def dedup_14_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").distinct().join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_anti")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_19_star(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's value per quarter from the newest source, with the fourth quarter derived from the year."""
    return win_03_derive_fourth_quarter(spark, sf_dir)
