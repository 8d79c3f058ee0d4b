"""The statement compiler: facts of many sources to one consolidated, derived set of cells, as one plan or step by step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.keep import keep_first
from tallyframe.operators import coverage
from tallyframe.operators import statements as st
from tallyframe.session import Scratch


def compile_statements(facts: DataFrame, files: DataFrame, masters: DataFrame | None = None) -> DataFrame:
    """stmt, row_id, year, period, value, how: per cell the newest file's value, gaps filled from older files, and
    derived periods. facts: stmt, row_id, concept, period, file, pos, value; files: file, recency."""
    buckets = st.bucket_values(facts, masters)
    cells = st.newest_value(buckets, files)
    filled = st.fill_gaps(cells, buckets, files)
    methods = cells.select(*st.CELL, "method")
    return st.derive(filled.join(methods, st.CELL, "left"))


@dataclass
class Compiled:
    """rows: stmt, row_id, display_order, display_label, depth. concept_map: stmt, concept, row_id, status. cells: stmt,
    row_id, period, value, how (the last step that set it). conflicts and unresolved as their steps give them; checks:
    check, stmt, row_id, period or year, gap, passed."""

    rows: DataFrame
    concept_map: DataFrame
    cells: DataFrame
    conflicts: DataFrame
    unresolved: DataFrame
    checks: DataFrame


NET_LABEL = r"net interest|interest expense net|interest income expense net"


def master_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of the newest annual workbook: each concept once, in its order, with label and depth."""
    master = st.pick_master(files.withColumnRenamed("file", "filename")).select(F.col("filename").alias("file"))
    first = keep_first(lines.join(F.broadcast(master), "file").where(F.trim(F.coalesce("concept", F.lit(""))) != ""), ["stmt", "concept"], ["pos", "label"])  # one file
    order = F.row_number().over(Window.partitionBy("stmt").orderBy("pos", "concept")) - 1
    return first.select("stmt", F.col("concept").alias("row_id"), "concept", F.coalesce("label", "concept").alias("display_label"), F.coalesce("depth", F.lit(0)).alias("depth"), order.alias("display_order"))


def net_interest_row(rows: DataFrame) -> str | None:
    """The income statement's row for net interest: by a combined concept, else by its label, else interest expense."""
    label = F.trim(F.regexp_replace(F.regexp_replace(F.lower("display_label"), r"[^a-z0-9\s]", " "), r"\s+", " "))
    named = st.text.local_name(F.col("row_id"))
    about = label.rlike(NET_LABEL) | (label.contains("interest") & label.contains("net") & ~label.contains("tax"))
    rank = F.when(named.rlike(st.NET_INTEREST), 0).when(about, 1).when(named.rlike("(?i)InterestExpense") & ~named.rlike("(?i)Income"), 2)
    got = rows.where("stmt = 'income_statement'").withColumn("rank", rank).where("rank is not null").orderBy("rank", "display_order").select("row_id").first()
    return got.row_id if got else None


def compile_workbooks(cells: DataFrame, lines: DataFrame, files: DataFrame, external: DataFrame | None = None) -> Compiled:
    """Workbooks to one set of statements, every step in its order: sparse columns go, late quarters are relabelled, the
    newest annual workbook gives the rows, other concepts are mapped by name, label, an outside mapping or position,
    interest is netted, the newest file's values win, coverage passes, derived periods, a last reconciliation with the
    raw facts, periods derived anew if that found any, and checks.

    cells: stmt, file, sheet, pos, concept, label, period, value. lines: stmt, file, pos, concept, label, depth (every
    line, with or without values). files: file, latest_fy, is_10k. external: stmt, concept, row_id (from outside, taken
    where the row exists). Each step's result is written to the shared folder, so plans stay small and a lost executor
    repeats one step; tables that no later step reads are dropped. What is returned stays there."""
    spark = cells.sparkSession
    s = Scratch(spark, "compile")
    sheet = F.concat_ws("\x1f", "file", "sheet")
    dense = st.drop_sparse_columns(cells.withColumn("__sheet", sheet), "__sheet").drop("__sheet")
    facts = st.relabel_shifted(st.fiscal_shift(dense)).drop("shifted", "period").withColumnRenamed("new_period", "period")
    facts = s.write(facts.select("stmt", "file", "pos", "concept", "label", "period", F.col("value").cast("double").alias("value")), "facts")
    ranked = s.write(st.recency(files.withColumnRenamed("file", "filename")).withColumnRenamed("filename", "file"), "files")

    rows = s.write(master_rows(lines, ranked), "master")
    others = keep_first(lines.where(F.trim(F.coalesce("concept", F.lit(""))) != ""), ["stmt", "concept"], ["file", "pos", "label"]).select("stmt", "concept", "label")
    others = others.join(rows.select("stmt", "concept"), ["stmt", "concept"], "left_anti")
    matched = st.match_concepts(others, rows).select("stmt", "concept", "row_id", F.when(F.col("method") == "local_name", "auto_local_name").when(F.col("method") == "label", "auto_label_match").alias("status"))
    if external is not None:
        told = st.accept_external(external, rows).groupBy("stmt", "concept").agg(F.min("row_id").alias("told"))
        matched = matched.join(told, ["stmt", "concept"], "left").select("stmt", "concept", F.coalesce("row_id", "told").alias("row_id"), F.coalesce("status", F.when(F.col("told").isNotNull(), "external")).alias("status"))
    matched = s.write(matched, "matched")
    entries = rows.select("stmt", "concept", "row_id", F.lit("auto_from_master").alias("status")).unionByName(matched.where("row_id is not null"))
    state = coverage.Covered(rows.select("stmt", "row_id", "display_order"), entries, facts)
    state = coverage.add_rows(state, matched.where("row_id is null"), lines.select("stmt", "file", "pos", "concept"), "auto_from_filing")
    concept_map, order = state.concept_map, s.write(state.rows, "rows")
    target = net_interest_row(rows)
    legs = st.interest_leg(F.col("concept")).isin("income", "expense") & (F.col("stmt") == "income_statement") & F.lit(target is not None)
    concept_map = s.write(concept_map.select("stmt", "concept", F.when(legs, F.lit(target)).otherwise(F.col("row_id")).alias("row_id"), F.when(legs, "interest_net_alias").otherwise(F.col("status")).alias("status")), "map")

    mapped = facts.join(concept_map.select("stmt", "concept", "row_id"), ["stmt", "concept"])
    unresolved = s.write(facts.join(concept_map.select("stmt", "concept"), ["stmt", "concept"], "left_anti"), "unresolved")
    netted = st.net_interest(mapped.where(F.col("row_id") == F.lit(target)), st.BUCKET) if target is not None else None
    buckets = st.bucket_values(mapped, rows.select("stmt", "row_id", F.col("concept").alias("master_concept")))
    if netted is not None:
        one = netted.select(*st.BUCKET, "value", F.lit(1).cast("long").alias("n_concepts"), "method")
        buckets = buckets.join(one.select(*st.BUCKET), st.BUCKET, "left_anti").select(*one.columns).unionByName(one)
    buckets = s.write(buckets, "buckets")
    newest = s.write(st.newest_value(buckets, ranked), "newest")

    covered, left = coverage.cover(order, concept_map, newest, facts, unresolved, lines.select("stmt", "file", "pos", "concept"), ranked, s)
    order, concept_map = covered.rows, s.write(covered.concept_map, "map")
    methods = newest.select(*st.CELL, "method")

    def derived(held: DataFrame, step: str) -> DataFrame:
        """Cells of named periods with what can be derived, and cells of other periods as they are."""
        known = held.join(methods, st.CELL, "left").withColumn("method", F.coalesce("method", F.lit("reported")))
        out = st.derive(known).select(*st.CELL, "value", F.col("how").alias("step"))
        both = out.join(held.select(*st.CELL, "how"), st.CELL, "left").select(*st.CELL, "value", F.when(F.col("step") == "kept", F.coalesce("how", F.lit("derived"))).otherwise(F.col("step")).alias("how"))
        rest = held.where("value is not null").join(both.select(*st.CELL), st.CELL, "left_anti").select(*st.CELL, "value", "how")
        return s.write(both.unionByName(rest), step)

    out = derived(covered.cells, "derived")
    checked = st.reconcile_final(out, facts, concept_map, ranked)
    found = s.write(checked.where("filled").select(*st.CELL, "value", F.lit("final_reconcile").alias("how")), "found")
    if not found.isEmpty():
        out = derived(out.unionByName(found), "derived")
        left = st.prune_mapped(left, concept_map)
    left = s.write(left, "left")
    sums = st.check_quarter_sum(out.withColumn("method", F.lit("reported")))
    checks = s.write(sums.select(F.lit("quarters sum to the year").alias("check"), "stmt", "row_id", "year", "gap", "passed"), "checks")
    shown = keep_first(lines.select("stmt", F.col("concept").alias("row_id"), "label", "depth", "file", "pos"), ["stmt", "row_id"], ["file", "pos"])
    labels = rows.select("stmt", "row_id", "display_label", "depth").unionByName(shown.join(rows, ["stmt", "row_id"], "left_anti").select("stmt", "row_id", F.coalesce("label", "row_id").alias("display_label"), F.coalesce("depth", F.lit(0)).alias("depth")))
    named = s.write(order.join(labels, ["stmt", "row_id"], "left").select("stmt", "row_id", "display_order", F.coalesce("display_label", "row_id").alias("display_label"), F.coalesce("depth", F.lit(0)).alias("depth")), "named")
    conflicts = s.write(st.conflicts(buckets, ranked), "conflicts")
    s.drop("facts", "master", "matched", "unresolved", "buckets", "newest", "found", "rows")
    return Compiled(named, concept_map, out, conflicts, left, checks)
