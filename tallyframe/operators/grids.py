"""Tables of a document that belong together, and the columns of a table by what their headers say.

A table is a row: key (document), number (its place), rows (array of rows of cells). What decides about a merge is a
handful of numbers per table; they alone are gathered per document. Cells move once, when the chosen tables are put
together, and the result is one row per line, never a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scores
from tallyframe.functions.classes import found
from tallyframe.session import ship

# fixed values: words of a header row, of an entity column, of a domicile column; regions in full
HEADER = r"\bsubsidiary\b|\blegal\b|\bjurisdiction\b|\bincorporat|\bownership\b|\b(?:percent(?:age)?|interest)\b|\bdomicile\b|\bdoing\s+business\b|\bname\s+of\b"
ENTITY = r"\bsubsidiar(?:y|ies)?\b|\blegal\s+name\b|\bentity\s+name\b|\bcompany\s+name\b"
DOMICILE = r"\bdomicile\b|\bjurisdiction\b|\b(?:state|country)\s+(?:of\s+)?(?:incorporat|\w+)"
NAMING, NAMING_WHOLE = r"\b(?:name|subsidiary|entity|company|legal)", r"\b(?:name|subsidiary|entity|company|legal)\b"
REGIONS = (
    r"^(DELAWARE|DEL|NEVADA|CALIFORNIA|NEW YORK|NEW\s+YORK|TEXAS|FLORIDA|ILLINOIS|OHIO|PENNSYLVANIA|GEORGIA|WASHINGTON|MARYLAND|VIRGINIA|TENNESSEE|MINNESOTA|COLORADO|MASSACHUSETTS|MICHIGAN|WISCONSIN|CONNECTICUT|MISSOURI|LOUISIANA|ALASKA|SOUTH\s+CAROLINA"
    r"|NEW\s+JERSEY|ARIZONA|OREGON|UTAH)\b"
)
SUFFIX = r"\b(Inc|LLC|Corp|Ltd)\b"
# fixed values: most difference of widths in a chain; points under which a table ends a chain or can't begin one
WIDTH_DELTA, ENDS_CHAIN, NO_START = 2, -700, -800


def _one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def header_row(row: Column) -> Column:
    """Whether a row of cells reads like the header of a list of subsidiaries; shares in brackets don't count."""
    text = F.regexp_replace(F.array_join(row, " | "), r"\(\s*\d{1,3}(?:\.\d+)?\s*%\s*\)", " ")
    return found(F.regexp_replace(text, r"\(\s*[0-9]{1,2}\s*%?\s*[–-]\s*[0-9]{1,2}\s*%?\s*\)", " "), HEADER)


def plausible_name(cell: Column) -> Column:
    """Whether a cell may hold the name of an entity."""
    t = _one_space(cell)
    return F.length(t).between(3, 240) & ~found(t, r"^of\s+incorporation|^state\s+or\s+country") & ~t.rlike(r"^\d{1,4}%?$|^\d+$") & t.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")


def region_like(cell: Column) -> Column:
    """Whether a cell looks like a jurisdiction: two letters or a region's name."""
    t = F.regexp_replace(_one_space(cell), r"\.$", "")
    return F.length(t).between(2, 40) & (t.rlike("^[A-Za-z]{2}$") | found(t, REGIONS))


# --- continuations ---

def table_facts(tables: DataFrame) -> DataFrame:
    """key, number, rows without blank ones, width, and numbers of each table as a whole (first) and without its header
    (rest): rows, full cells, whether lists of subsidiaries are named, brackets, shares, endings of names, characters,
    whether it ends in the name of a page. Tables of one column or one row can't be continued and are left out."""
    kept = F.filter(F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))), lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    t = tables.select("key", "number", kept.alias("rows")).withColumn("width", F.array_max(F.transform("rows", lambda r: F.size(r))))
    t = t.where((F.col("width") >= 2) & (F.size("rows") >= 2))
    t = t.withColumn("header", header_row(F.element_at("rows", 1))).withColumn("later", F.when(F.col("header"), F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows")))

    def numbers(rows: Column) -> Column:
        text = F.lower(F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), "\n"))
        line = F.regexp_replace(F.array_join(F.flatten(rows), ""), r"\s+", "")
        return F.struct(
            F.size(rows).alias("rows"), F.size(F.filter(F.flatten(rows), lambda c: F.length(F.trim(c)) > 1)).alias("full"), found(text, r"\blist\s+of\s+subsidiaries\b").alias("listed"), F.regexp_count(text, F.lit(r"\(")).alias("brackets"),
            F.regexp_count(text, F.lit(r"\(\s*\d{1,3}(?:\.\d+)?\s*%\)")).alias("shares"), found(text, scores.TABLE_SUFFIXES).alias("endings"), F.length(line).alias("chars"), found(line, r"\.htm(l)?$").alias("page"),
        )

    return t.select("key", "number", "rows", "later", "width", numbers(F.col("rows")).alias("first"), numbers(F.col("later")).alias("rest"))


def _points(parts: list[dict], width: int) -> float:
    """Size of merged tables and their points as a list of subsidiaries, from the numbers of its parts."""
    sums = {k: sum(p[k] for p in parts) for k in ("rows", "full", "brackets", "shares", "chars")}
    total = sums["rows"] * width * 8 + sums["full"]
    total += 400 * any(p["listed"] for p in parts) + 120 * any(p["endings"] for p in parts)
    total += min(sums["brackets"] * 14, 320) * (sums["brackets"] >= 2) + min(sums["shares"] * 22, 220) * (sums["shares"] >= 2)
    return float(total - 900 * (sums["chars"] < 180 and parts[-1]["page"]))


def _alone(t: dict) -> float:
    return _points([t["first"]], t["width"]) - t["first"]["rows"] * t["width"] * 8 - t["first"]["full"]


def best_chain(tables: list[dict]) -> tuple[list[int], float] | None:
    """Numbers and points of the best chain of tables in their order: a table goes on with the open one if their widths
    differ by 2 at most; the open one is as wide as its widest part. First of equals; None under two tables.

    Where a chain ends depends on its place and width alone, so ends are found from the last table back, and numbers of
    a chain are differences of running sums: time grows with the tables, not with their square."""
    if len(tables) < 2:
        return None
    numbers = ("rows", "full", "brackets", "shares", "chars", "listed", "endings")
    sums = [dict.fromkeys(numbers, 0)]
    for t in tables:
        sums.append({k: sums[-1][k] + int(t["rest"][k]) for k in numbers})
    ends: dict[int, tuple[int, int]] = {}  # width of a chain that holds this table -> its last table and final width
    best = None
    for s in range(len(tables) - 1, -1, -1):
        t, n, onward = tables[s], tables[s + 1] if s + 1 < len(tables) else None, ends
        stops = n is None or _alone(n) < ENDS_CHAIN or not n["rest"]["rows"]
        ends = {}
        for width in range(t["width"], t["width"] + WIDTH_DELTA + 1):
            ends[width] = (s, width) if stops or abs(width - n["width"]) > WIDTH_DELTA else onward[max(width, n["width"])]
        if _alone(t) < NO_START:
            continue
        end, width = ends[t["width"]]
        whole = {k: int(t["first"][k]) + sums[end + 1][k] - sums[s + 1][k] for k in numbers}
        points = _points([{**whole, "page": (t["first"] if end == s else tables[end]["rest"])["page"]}], width)
        if best is None or points >= best[2]:
            best = s, end, points
    return ([t["number"] for t in tables[best[0] : best[1] + 1]], best[2]) if best else None


def best_group(tables: list[dict]) -> tuple[list[int], float] | None:
    """As best_chain() for all tables of one width, wherever they stand; None if no width has two."""
    widths: dict[int, list[dict]] = {}
    for t in tables:
        widths.setdefault(t["width"], []).append(t)
    best = None
    for width, same in widths.items():
        points = _points([same[0]["first"], *(t["rest"] for t in same[1:])], width)
        if len(same) > 1 and (best is None or points > best[1]):
            best = ([t["number"] for t in same], points)
    return best


_NUMBERS = "struct<rows:int,full:int,listed:boolean,brackets:int,shares:int,endings:boolean,chars:int,page:boolean>"


def merge_tables(tables: DataFrame) -> DataFrame:
    """The list of subsidiaries of each document, put together from its tables: key, row (from 0), number (the table
    that it comes from), cells (padded to one width), way (chain, width or single), points.

    Chains of tables whose widths differ by 2 at most compete with all tables of one width and with the best single
    table by size and points; of equals the chain, then the width, stands. Repeated header rows and blank rows go.
    A document without a table of two rows and columns gives no rows. Words are looked for within tables, not across
    their borders."""
    ship(tables.sparkSession)
    facts = table_facts(tables)

    @F.udf("struct<w:int,numbers:array<int>,points:double>", useArrow=True)
    def best_way(tables):
        """Of the chain (3), the tables of one width (2) and single ones (1) the one with most points."""
        tables = [_dict(t) for t in tables]
        ways = [(p, w, numbers) for w, (numbers, p) in ((3, best_chain(tables) or (None, 0.0)), (2, best_group(tables) or (None, 0.0))) if numbers]
        ways += [(_points([t["first"]], t["width"]), 1, [t["number"]]) for t in tables]
        points, w, numbers = max(ways, key=lambda x: (x[0], x[1], [-n for n in x[2]]))
        return {"w": w, "numbers": numbers, "points": points}

    small = F.array_sort(F.collect_list(F.struct("number", "width", "first", "rest")))
    best = facts.groupBy("key").agg(small.alias("t")).select("key", best_way("t").alias("b"))
    chosen = best.select("key", F.col("b.w").alias("w"), F.col("b.points").alias("points"), F.posexplode("b.numbers").alias("place", "number"))
    held = chosen.join(facts.select("key", "number", "rows", "later", "width"), ["key", "number"])
    width = held.groupBy("key").agg(F.max("width").alias("widest"))
    lines = held.join(width, "key").select("key", "number", "w", "points", "place", "widest", F.posexplode(F.when(F.col("place") == 0, F.col("rows")).otherwise(F.col("later"))).alias("line", "cells"))
    from pyspark.sql import Window

    padded = F.concat("cells", F.array_repeat(F.lit(""), (F.col("widest") - F.size("cells")).cast("int")))
    row = F.row_number().over(Window.partitionBy("key").orderBy("place", "line")) - 1
    way = F.when(F.col("w") == 3, "chain").when(F.col("w") == 2, "width").otherwise("single")
    return lines.select("key", row.alias("row"), "number", padded.alias("cells"), way.alias("way"), "points")


def _dict(x):
    """A struct as Arrow functions hand it over, as plain dictionaries."""
    if hasattr(x, "asDict"):
        return x.asDict(recursive=True)
    return x


# --- columns ---

def _first_index(cells: Column, test) -> Column:
    """The place (from 0) of the first cell that passes, -1 for none."""
    return F.coalesce(F.array_min(F.transform(F.filter(F.transform(cells, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: test(F.trim(x["c"]))), lambda x: x["i"])), F.lit(-1))


def _column(header: Column, pattern: str) -> Column:
    """The header cell with a pattern, preferably not one named only "column 3"."""
    named = _first_index(header, lambda c: (F.length(c) > 0) & ~found(c, r"^column\s*\d+") & found(c, pattern))
    return F.when(named >= 0, named).otherwise(_first_index(header, lambda c: found(c, pattern)))


def subsidiary_rows(tables: DataFrame) -> DataFrame:
    """One row per entity of each table of subsidiaries: key, number, row (its place), name, jurisdiction ("" if there is none).

    Columns go by their headers: the entity's (else the first), the domicile's (else the one after the entity's, unless
    that is about names too). Rows whose entity cell is empty while the domicile cell reads like a name and the next
    like a region are shifted left by one. The name is the entity cell if plausible, else the first plausible other
    cell that isn't just a region; the jurisdiction is the domicile cell, else the first other region. Of one name (in
    any case) the first row stands. Null tables and cells are empty."""
    clean = F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    width = F.array_max(F.transform("g", lambda r: F.size(r)))
    t = tables.select("key", "number", clean.alias("g")).where(F.size("g") > 0).withColumn("w", width)
    t = t.withColumn("g", F.transform("g", lambda r: F.concat(r, F.array_repeat(F.lit(""), (F.col("w") - F.size(r)).cast("int")))))
    t = t.withColumn("headed", (F.size("g") >= 2) & header_row(F.element_at("g", 1)))
    t = t.withColumn("header", F.when(F.col("headed"), F.element_at("g", 1)).otherwise(F.array().cast("array<string>")))
    entity, domicile = _column(F.col("header"), ENTITY), _column(F.col("header"), DOMICILE)
    t = t.withColumns({"entity": F.greatest(entity, F.lit(0)), "dom": domicile, "named": F.greatest(_first_index(F.col("header"), lambda c: found(c, ENTITY)), F.lit(0)), "jur": _first_index(F.col("header"), lambda c: found(c, DOMICILE))})
    beside = lambda i: F.coalesce(F.trim(F.get("header", i + 1)), F.lit(""))
    t = t.withColumn("dom", F.when((F.col("dom") < 0) & (F.size("header") >= F.col("entity") + 2) & ~found(beside(F.col("entity")), NAMING), F.col("entity") + 1).otherwise(F.col("dom")))
    t = t.withColumn("jur", F.when((F.col("jur") < 0) & (F.col("named") + 1 < F.size("header")) & ~found(beside(F.col("named")), NAMING_WHOLE), F.col("named") + 1).otherwise(F.col("jur")))
    rows = t.select("key", "number", "headed", "w", "entity", "dom", "named", "jur", F.posexplode(F.when(F.col("headed"), F.slice("g", F.lit(2), F.size("g"))).otherwise(F.col("g"))).alias("row", "r"))
    at = lambda i: F.coalesce(F.trim(F.get("r", i)), F.lit(""))
    shifted = F.col("headed") & (F.col("dom") >= 0) & (at(F.col("entity")) == "") & plausible_name(at(F.col("dom"))) & (F.col("dom") + 1 < F.size("r")) & region_like(at(F.col("dom") + 1))
    moved = F.transform("r", lambda c, i: F.when(i == F.col("dom"), at(F.col("dom") + 1)).when(i == F.col("entity"), at(F.col("dom"))).when(i > F.col("dom"), _one_space(F.get("r", i + 1))).otherwise(c))
    rows = rows.withColumn("r", F.when(shifted, moved).otherwise(F.col("r")))
    rows = rows.withColumn("named", F.when(F.col("named") < F.size("r"), F.col("named")).otherwise(0))

    def entity_like(c: Column) -> Column:
        bare = region_like(c) & (F.length(c) <= 14) & ~c.rlike("[,.]") & ~found(c, SUFFIX)
        return plausible_name(c) & ~bare & ~found(c, r"^of\s+incorporation|^state\s+or\s+country")

    own = at(F.col("named"))
    other = F.try_element_at(F.filter(F.transform("r", lambda c: F.trim(c)), entity_like), F.lit(1))
    rows = rows.withColumn("name", F.when(entity_like(own), own).otherwise(other)).where("name is not null")
    cells = F.filter(F.transform("r", lambda c, i: F.struct(i.alias("i"), _one_space(c).alias("c"))), lambda x: (x["i"] != F.col("named")) & (x["c"] != F.col("name")) & region_like(x["c"]))
    jurisdiction = F.when((F.col("jur") >= 0) & (_one_space(F.get("r", F.col("jur"))) != ""), _one_space(F.get("r", F.col("jur")))).otherwise(F.coalesce(F.try_element_at(cells, F.lit(1))["c"], F.lit("")))
    rows = rows.select("key", "number", "row", _one_space(F.col("name")).alias("name"), F.lower("name").alias("same"), jurisdiction.alias("jurisdiction"))
    return rows.groupBy("key", "number", "same").agg(F.min_by(F.struct("row", "name", "jurisdiction"), "row").alias("f")).select("key", "number", "f.*")
