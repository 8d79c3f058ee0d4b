"""Queries of printed statements against facts, and of searches in an index of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import consolidation, vector_index
from tallyframe.plans.compile import compile_workbooks
from tallyframe.plans.queries import query, table
from tallyframe.session import materialize, new_path


def _statements(spark, sf_dir):
    """Each customer's orders by year as facts, and as a printed statement: cells of even years are one too high, those of
    every seventh customer are in thousands, and every fifth customer's line has another name."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    year = F.col("y").cast("string")
    facts = o.select("key", F.lit("is").alias("kind"), F.lit("x:Total").alias("concept"), F.lit("Total sales").alias("line"), F.concat(year, F.lit("-01-01 to "), year, F.lit("-12-31")).alias("period"), "value", F.col("y").alias("pos"))
    wrong = F.when(F.col("key") % 7 == 0, F.col("value") / 1000).when(F.col("y") % 2 == 0, F.col("value") + 1).otherwise(F.col("value"))
    cells = o.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("y", consolidation.printed_money(wrong).alias("c")))).alias("a"))
    name = F.when(F.col("key") % 5 == 0, "Other").otherwise("**Total Sales**")
    part = lambda f: F.array_join(F.transform("a", f), " | ")
    text = F.concat(F.lit("# Income statement\n\n| Line | Concept | "), part(lambda x: F.concat(F.lit("FY"), x["y"].cast("string"))), F.lit(" |\n| --- | --- | "), part(lambda x: F.lit("---")), F.lit(" |\n| "), name, F.lit(" | x:Total | "), part(lambda x: x["c"]), F.lit(" |\nend"))
    return cells.select("key", text.alias("text")), facts


_PRINTED = """WITH o AS (SELECT o_custkey AS key, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"""


@query(_PRINTED + """, p AS (SELECT *, CASE WHEN key % 7 = 0 THEN round(value / 1000, 2) WHEN y % 2 = 0 THEN round(value + 1, 2) ELSE value END AS printed, row_number() OVER (PARTITION BY key ORDER BY y) AS n FROM o)
SELECT key, y::INT AS pos, value, CASE WHEN key % 5 <> 0 THEN printed END AS printed, CASE WHEN key % 5 = 0 THEN 'no line' WHEN abs(printed - value) <= 0.02 THEN 'right' ELSE 'wrong' END AS status,
  CASE WHEN key % 5 <> 0 AND abs(printed - value) > 0.02 AND key % 7 = 0 THEN 'thousands' END AS hint FROM p""")
def val_07_check_statements(spark, sf_dir):
    docs, facts = _statements(spark, sf_dir)
    return consolidation.check_statements(docs, facts).select("key", "pos", "value", "printed", "status", "hint")


@query(_PRINTED + " SELECT DISTINCT key, 'is' AS kind, 'x:Total' AS concept FROM o WHERE key % 5 = 0")
def val_07_missing_concepts(spark, sf_dir):
    return consolidation.missing_concepts(*_statements(spark, sf_dir))


@query(_PRINTED + """ SELECT key, '# Income statement' || chr(10) || chr(10) || '| Line | Concept | ' || string_agg('FY' || y, ' | ' ORDER BY y) || ' |' || chr(10) || '| --- | --- | ' || string_agg('---', ' | ') || ' |' || chr(10) || '| ' || CASE WHEN key % 5 = 0 THEN 'Other' ELSE '**Total Sales**' END
  || ' | x:Total | ' || string_agg(format('{:,.2f}', value), ' | ' ORDER BY y) || ' |' || chr(10) || 'end' AS text FROM o GROUP BY key""")
def val_08_repair_statements(spark, sf_dir):
    docs, facts = _statements(spark, sf_dir)
    return consolidation.repair_statements(docs, facts)


def _indexed(spark, sf_dir):
    path = new_path(spark, "embeddings-index")
    vector_index.save_index(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding", cells=16)
    return vector_index.load_index(spark, path)


_COSINES = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings), p AS (
  SELECT a.vec_id AS query, b.vec_id AS key, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / ((CASE WHEN a.n = 0 THEN 1 ELSE a.n END) * (CASE WHEN b.n = 0 THEN 1 ELSE b.n END)) AS cosine FROM e a JOIN e b ON a.vec_id % 100 = 0)"""


@query(_COSINES + " SELECT query, key, round(cosine, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(cosine, 12) DESC, key) <= 10")
def src_34_exact_search(spark, sf_dir):
    """Every hundredth vector against all rows of a saved and loaded index, all cells."""
    found = vector_index.search(_indexed(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0"), 10, "vec_id", "embedding")
    return found.select("query", "key", F.round("cosine", 6).alias("cosine"))


@query()
def src_34_index_search(spark, sf_dir):
    """The same in the nearest twelve of sixteen cells: 0.94 or more of the exact answers here (README)."""
    return vector_index.search(_indexed(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0"), 10, "vec_id", "embedding", probes=12)


def _workbooks(spark, sf_dir):
    """Order priorities as workbooks: the first is annual, the others have three quarters a year. Concepts have another
    prefix in the second and other names but like labels in the fifth; the third has a line that no other has."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("fs"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), "l_extendedprice")
    rows = materialize(rows.groupBy("file", "fs", "y", "q").agg(F.sum("l_extendedprice").alias("x"), F.count("*").alias("n")), "workbooks")  # the one join that all steps read
    annual = F.col("file") == "1-URGENT"
    year = F.date_format(F.make_date("y", F.lit(1), F.lit(1)), "yy")
    period = F.when(annual, F.concat(F.lit("FY"), year)).otherwise(F.concat(F.col("q").cast("string"), F.lit("Q"), year))
    kept = rows.where(annual | (F.col("q") < 4)).withColumn("period", period)
    values = kept.groupBy("file", "fs", "period").agg(F.round(F.sum("x"), 2).alias("value"))
    extra = kept.where("file = '3-MEDIUM'").groupBy("file", F.lit("Extra").alias("fs"), "period").agg(F.sum("n").cast("double").alias("value"))
    fs = F.col("fs")
    prefix = F.when(fs == "Extra", "z:").when(F.col("file") == "2-HIGH", "x:").when(F.col("file") == "5-LOW", "y:Other").otherwise("us:")
    named = {"stmt": F.lit("income_statement"), "concept": F.concat(prefix, fs), "label": F.concat(F.lit("Line "), F.substring(fs, 1, 1), F.lit(" "), F.substring(fs, 2, 9)), "pos": F.when(fs == "Extra", 2500).otherwise(F.ascii(fs) * 100 + F.ascii(F.substring(fs, 2, 1))).cast("long"), "sheet": F.lit("IS"), "depth": F.lit(0)}
    cells = values.unionByName(extra).withColumns(named)
    lines = rows.select("fs").distinct().join(F.broadcast(rows.select("file").distinct()))  # five files, four concepts
    lines = lines.unionByName(spark.createDataFrame([("Extra", "3-MEDIUM")], "fs string, file string")).withColumns(named)
    files = rows.select("file").distinct().select("file", F.lit(1998).alias("latest_fy"), (F.col("file") == "1-URGENT").alias("is_10k"))
    return cells, lines, files


@query("""WITH r AS (SELECT o_orderpriority AS file, l_returnflag || l_linestatus AS fs, right(year(o_orderdate)::VARCHAR, 2) AS yy, quarter(o_orderdate) AS q, l_extendedprice AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, CASE WHEN file = '1-URGENT' THEN 'FY' || yy ELSE q || 'Q' || yy END AS period FROM r WHERE file = '1-URGENT' OR q < 4), v AS (SELECT file, 'us:' || fs AS row_id, yy, period, round(sum(x), 2) AS value FROM k GROUP BY ALL UNION ALL SELECT file, 'z:Extra', yy, period, count(*) FROM k WHERE file = '3-MEDIUM' GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY file, period) AS n FROM v), d AS (SELECT *, max(n) OVER (PARTITION BY file) AS most FROM n), c AS (SELECT row_id, yy, period, arg_max(value, file) AS value FROM d WHERE n >= 0.5 * most GROUP BY ALL),
w AS (SELECT row_id, yy, max(value) FILTER (period = 'FY' || yy) AS fy, coalesce(max(value) FILTER (period = '1Q' || yy), 0) + coalesce(max(value) FILTER (period = '2Q' || yy), 0) + coalesce(max(value) FILTER (period = '3Q' || yy), 0) AS q3 FROM c GROUP BY ALL)
SELECT row_id, period, round(value, 2) AS value, 'kept' AS how FROM c UNION ALL SELECT row_id, '4Q' || yy, round(fy - q3, 2), 'derived' FROM w WHERE fy IS NOT NULL""")
def plan_compile_workbooks(spark, sf_dir):
    out = compile_workbooks(*_workbooks(spark, sf_dir)).cells
    return out.select("row_id", "period", F.round("value", 2).alias("value"), F.when(F.col("how") == "derived", "derived").otherwise("kept").alias("how"))


@query("""WITH c AS (SELECT DISTINCT l_returnflag || l_linestatus AS fs FROM lineitem) SELECT 'us:' || fs AS concept, 'us:' || fs AS row_id, 'auto_from_master' AS status FROM c UNION ALL SELECT 'x:' || fs, 'us:' || fs, 'auto_local_name' FROM c UNION ALL SELECT 'y:Other' || fs, 'us:' || fs, 'auto_label_match' FROM c
UNION ALL SELECT 'z:Extra', 'z:Extra', 'auto_from_filing'""")
def plan_compile_map(spark, sf_dir):
    return compile_workbooks(*_workbooks(spark, sf_dir)).concept_map.select("concept", "row_id", "status")
