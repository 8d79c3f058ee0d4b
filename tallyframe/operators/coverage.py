"""Coverage of a compiled statement: no line of a source and no value may be missing from the rows, the map and the cells.

The passes run in a fixed order, each on what the one before gave: repair cells that mapped facts have, register lines
without facts, integrate concepts with facts but no map entry, integrate what mapping left unresolved, fill the rest.
rows: stmt, row_id, display_order; concept_map: stmt, concept, row_id; cells: stmt, row_id, period, value;
lines: stmt, file, pos, concept (every line of the sheets, with or without facts); files: file, recency.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import periods
from tallyframe.functions.keep import keep_first
from tallyframe.operators import statements as st
from tallyframe.session import Scratch

KEY = ["stmt", "concept"]


@dataclass
class Covered:
    """rows, concept_map (with status) and cells (with how) after the passes so far."""

    rows: DataFrame
    concept_map: DataFrame
    cells: DataFrame


def add_rows(state: Covered, concepts: DataFrame, lines: DataFrame, status: str) -> Covered:
    """New rows and map entries for concepts (stmt, concept) that the map doesn't have.

    A row stands after its anchor, the nearest earlier line with a map entry in the first file (by name) that has the
    concept; rows with one anchor go by concept, rows without one come first. Anchors are lines mapped before this pass."""
    missing = concepts.select(*KEY).where(F.trim("concept") != "").distinct().join(state.concept_map.select(*KEY), KEY, "left_anti")
    placed = lines.join(state.concept_map.select("stmt", "concept", "row_id"), KEY, "left")
    anchored = st.anchors(placed, ["stmt", "file"], "pos").select(*KEY, "file", "pos", "anchor")
    first = keep_first(anchored.join(missing, KEY, "left_semi"), KEY, ["file", "pos"])
    new = missing.join(first.select(*KEY, "anchor"), KEY, "left")
    seq = F.row_number().over(Window.partitionBy("stmt", "anchor").orderBy("concept")) - 1
    fresh = new.join(state.rows.select("stmt", F.col("row_id").alias("concept")), KEY, "left_anti").select("stmt", F.col("concept").alias("row_id"), "anchor", seq.alias("seq"))
    entries = missing.select(*KEY, F.col("concept").alias("row_id"), F.lit(status).alias("status"))
    return Covered(st.insert_after(state.rows, fresh, ["stmt"]), state.concept_map.unionByName(entries), state.cells)


def merge_values(state: Covered, facts: DataFrame, files: DataFrame, how: str) -> Covered:
    """Cells that are empty get the newest file's value of facts: stmt, concept, period, file, value, mapped by now."""
    named = facts.where("value is not null").join(state.concept_map.select("stmt", "concept", "row_id"), KEY).join(files.select("file", "recency"), "file")
    newest = named.groupBy(*st.CELL).agg(F.max_by("value", F.struct("recency", "file")).alias("found"))
    both = state.cells.join(newest, st.CELL, "full")
    filled = F.col("value").isNull() & F.col("found").isNotNull()
    cells = both.select(*st.CELL, F.coalesce("value", "found").alias("value"), F.when(filled, how).otherwise(F.col("how")).alias("how"))
    return Covered(state.rows, state.concept_map, cells)


def cover(rows: DataFrame, concept_map: DataFrame, cells: DataFrame, facts: DataFrame, unresolved: DataFrame, lines: DataFrame, files: DataFrame, scratch: Scratch | None = None) -> tuple[Covered, DataFrame]:
    """All passes in their order, and what stays unresolved: lines without concept, statement, value or period.

    facts and unresolved: stmt, concept, period, file, value. Each pass is written to the shared folder, so that the
    plan doesn't grow with the passes."""
    made = scratch or Scratch(rows.sparkSession, "cover")
    names = ("rows", "concept_map", "cells")

    def written(x: Covered, n: int) -> Covered:
        out = Covered(*(made.write(getattr(x, name), f"cover-{name}-{n}") for name in names))
        made.drop(*(f"cover-{name}-{n - 1}" for name in names))  # read by the tables just written only
        return out

    state = Covered(rows.select("stmt", "row_id", "display_order"), (concept_map if "status" in concept_map.columns else concept_map.withColumn("status", F.lit("mapped"))).select("stmt", "concept", "row_id", "status"), cells.select(*st.CELL, "value").withColumn("how", F.lit("consolidated")))
    state = merge_values(state, facts, files, "repaired")
    state = written(add_rows(state, lines, lines, "row_order_registry"), 0)
    known = facts.where(F.trim("concept") != "")
    state = add_rows(state, known, lines, "explicit_workbook_line")
    state = written(merge_values(state, known, files, "explicit_workbook_line"), 1)
    whole = (F.trim(F.coalesce("concept", F.lit(""))) != "") & F.col("stmt").isNotNull() & F.col("value").isNotNull() & periods.period_type(F.col("period")).isNotNull()
    usable = unresolved.where(whole)
    state = add_rows(state, usable, lines, "coverage_integrated")
    state = written(merge_values(state, usable, files, "coverage_integrated"), 2)
    state = written(merge_values(state, facts, files, "workbook_fill"), 3)
    left = unresolved.where(~F.coalesce(whole, F.lit(False)))
    return state, left
