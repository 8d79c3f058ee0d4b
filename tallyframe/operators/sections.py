"""Where the sections of a filing's text begin and end, and what lies inside them.

Marks are found in one pass over each text in Arrow batches: a mark is a place where a section may begin or end. What
begins with what is then a question of rows: for every possible start the first end of each kind after it, spans over
the least length, the longest span of the first pass that has any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scores
from tallyframe.session import ship

# fixed values: where the discussion section may begin, by form, in order
_TITLE = r"MANAGEMENT'?S\s+DISCUSSION\s+AND\s+ANALYSIS"
_FULL = _TITLE + r"\s+OF\s+FINANCIAL\s+CONDITION\s+AND\s+RESULTS\s+OF\s+OPERATIONS\b"
STARTS = {
    "10-K": [r"\bITEM\s+7[.—–-]\s*" + _FULL, r"\bITEM\s+7\s+" + _TITLE + r"\b"],
    "10-Q": [r"\bITEM\s+2[.—–-]\s*" + _FULL, r"\bITEM\s+2[.—–-]\s*" + _TITLE + r"\b", r"\bITEM\s+2\s+" + _TITLE + r"\b", r"\bITEM\s+2[.—–-]\s*MD&A\b", r"\bPART\s+I\s+ITEM\s+2[.—–-]\s*MANAGEMENT'?S\s+DISCUSSION\b"],
}
ITEM = {"10-K": r"\bITEM\s+7[.—–-]", "10-Q": r"\bITEM\s+2[.—–-]"}
# fixed values: where it may end (label, pattern, counts however near)
ENDS = {
    "10-K": [("Item 7A", r"\bITEM\s+7A[.—–-]\s*QUANTITATIVE\b", True), ("Item 8", r"\bITEM\s+8[.—-]\s*FINANCIAL\s+STATEMENTS\b", True)],
    "10-Q": [
        ("Item 3", r"\bITEM\s+3[.—–-]\s*QUANTITATIVE\b", True), ("Item 4", r"\bITEM\s+4[.—–-]\s*(?:CONTROLS|MINE\s+SAFETY)", True), ("Item 1 Legal", r"\bITEM\s+1[.—–-]\s*LEGAL\s+PROCEEDINGS\b", True),
        ("Item 3 (heading)", r"\bITEM\s+3[.—–-]", False), ("Item 4 (heading)", r"\bITEM\s+4[.—–-]", False), ("Part II", r"\bPART\s+II\b", False), ("Signatures", r"\bSIGNATURES?\b", False),
    ],
}
WEAKER_END = ("Item 3 (weak)", r"\bITEM\s+3\b")
# fixed values: least lengths and offsets in characters
LEAST_SPAN = {"10-K": 4000, "10-Q": 1500}
LEAST_OFFSET = {"10-K": 12_000, "10-Q": 5000}
LOOSE_SPAN, LOOSE_OFFSET, BARE_OFFSET, NEAR_END, NEAR_SIGNATURES = 600, 3200, 1400, 3400, 120
# fixed values: words of the discussion's text
CUE = r"\b(results\s+of\s+operations|liquidity|capital\s+resources|critical\s+accounting|covid|macroeconomic|non-gaap|adjusted\s+ebitda|segment|overview)\b"
LOOSE_CUE = r"\b(revenue|sales|expenses|margin|earnings|guidance|outlook|performance|financial\s+results|operating\s+results|business\s+overview|interim|quarterly\s+results|cash\s+flows?|covid)\b"
IN_CONTENTS = r"\b(results\s+of\s+operations|liquidity|capital\s+resources|critical\s+accounting|covid|macroeconomic|overview)\b"
HEADS = [(220, r"discussion|analysis|financial\s+condition|results\s+of\s+operations|md\s*&\s*a|mda\b"), (280, r"discussion|analysis|financial|operations|results|condition|md\s*&\s*a"), (420, r"(discussion|analysis|financial|operations|results|condition|management|md\s*&|overview|liquidity)")]

_FLAGS = re.I | re.A
_CITED = [re.compile(p) for p in (r"[,;]", "[\"“”]", "\\.\\s*[“”‘’\"]+\\s*[A-Za-z]", r"\.\s+[a-z]")]
_ITEM_8 = re.compile(r"\bITEM\s+8[.—–-]\s*Financial\s+Statements\s+and\s+Supplementary\s+Data", _FLAGS)
_SPACES = re.compile(r"\s+")


def _cited(text: str, at: int) -> bool:
    """Whether the heading of Item 8 is quoted within a sentence."""
    m = _ITEM_8.search(text, at, at + 200)
    rest = text[m.end() : at + 200].lstrip() if m else ""
    return any(p.match(rest) for p in _CITED)


def _contents_row(text: str, at: int) -> bool:
    """Whether a page number follows soon after, and little else."""
    head = text[at : at + 420]
    page = re.search(r"\bpage\s*\d{1,3}\b", head, _FLAGS)
    if not page or not 0 < page.start() <= 320:
        return False
    before = head[: page.start()]
    return not re.search(IN_CONTENTS, before, _FLAGS) and len(_SPACES.sub(" ", before).strip()) < 200


def marks_of(text: str, form: str) -> list[tuple]:
    """Marks of one text: (offset, kind, number, label, near, cue, loose_cue, heads). kind start: number is the place
    of its pattern, or -1 for the item alone; near marks count only from a distance."""
    out: list[tuple] = []
    item = "7" if form == "10-K" else "2"
    for number, pattern in [*enumerate(STARTS[form]), (-1, ITEM[form])]:
        for m in re.finditer(pattern, text, _FLAGS):
            at = m.start()
            if re.match(rf"item\s+{item}\s+of\b", text[at : at + 40], _FLAGS) or _contents_row(text, at):
                continue
            cue = bool(re.search(CUE, text[at : at + 2500], _FLAGS))
            heads = [bool(re.search(p, text[at : at + n], _FLAGS)) for n, p in HEADS]
            out.append((at, "start", number, _SPACES.sub(" ", m[0][:80]), False, cue, cue or bool(re.search(LOOSE_CUE, text[at : at + 3200], _FLAGS)), heads))
    for label, pattern, strong in ENDS[form] + ([(*WEAKER_END, False)] if form == "10-Q" else []):
        for m in re.finditer(pattern, text, _FLAGS):
            if label != "Item 8" or not _cited(text, m.start()):
                out.append((m.start(), "end", 0, label, not strong, False, False, []))
    return out


_MARK = "key {key}, form string, length long, at long, kind string, number int, label string, near boolean, cue boolean, loose_cue boolean, heads array<boolean>"


def section_marks(df: DataFrame, key: str = "key", text: str = "text", form: str = "form") -> DataFrame:
    """One row per mark of each text. form other than 10-K counts as 10-Q. A null text is empty."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.when(F.coalesce(F.col(form), F.lit("")).contains("10-K"), "10-K").otherwise("10-Q").alias("form"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.bool_())]
        names = ["key", "form", "length", "at", "kind", "number", "label", "near", "cue", "loose_cue", "heads"]
        for b in batches:
            for i in range(len(b)):
                form, text = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                made = [(form, len(text), *m) for m in marks_of(text, form)]
                if not made:
                    continue
                keys = pa.array([b.column(0)[i].as_py()] * len(made), b.schema.types[0])
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*made), types))], names=names)

    return rows.mapInArrow(find, _MARK.format(key=kind))


def discussion_bounds(df: DataFrame, key: str = "key", text: str = "text", form: str = "form") -> DataFrame:
    """One row per text that has a discussion section: key, start, end, start_label, end_label, confidence (high;
    medium for an early start; low without its words). key must be unique.

    The end is the first of the marks after the start (strong ones at any distance, others from 3400 characters on; of
    each kind the first after the start only), or the text's end. Spans under the least length don't count. Passes, in
    order: full titles; the item alone with words of the title near; for quarterly reports both again with shorter
    spans and looser words, then the bare item. The first pass with any span gives the longest, the first on ties."""
    marks = section_marks(df, key, text, form)
    strong = [x[0] for f in ENDS.values() for x in f if x[2]]
    weak = [x[0] for f in ENDS.values() for x in f if not x[2]] + [WEAKER_END[0]]
    # of each kind of end the first after a mark: marks of one text, read backwards
    after = Window.partitionBy("key").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    firsts = {label: F.min(F.when((F.col("kind") == "end") & (F.col("label") == label), F.col("at"))).over(after) for label in strong + weak}
    held = marks.select("*", *[v.alias(f"__{i}") for i, v in enumerate(firsts.values())]).where("kind = 'start'")
    at, far = F.col("at"), F.col("at") + NEAR_END
    ends = []
    for i, label in enumerate(strong + weak):
        c = F.col(f"__{i}")
        fits = c.isNotNull() & (F.lit(label in strong) | (c >= far)) & (F.lit(label != "Signatures") | (c > at + 1 + NEAR_SIGNATURES))
        ends.append((label, F.when(fits, F.struct(c.alias("at"), F.lit(i).alias("n"), F.lit(label).alias("label")))))
    usual = F.array_min(F.filter(F.array(*[c for label, c in ends if label != WEAKER_END[0]]), lambda x: x.isNotNull()))
    end = F.coalesce(usual, dict(ends)[WEAKER_END[0]], F.struct(F.col("length").alias("at"), F.lit(99).alias("n"), F.lit("(eof)").alias("label")))
    held = held.withColumn("end", end).withColumn("span", F.col("end.at") - at)
    annual, titled, cue, loose = F.col("form") == "10-K", F.col("number") >= 0, F.col("cue"), F.col("loose_cue")
    least_span = F.when(annual, LEAST_SPAN["10-K"]).otherwise(LEAST_SPAN["10-Q"])
    early = at < F.when(annual, LEAST_OFFSET["10-K"]).otherwise(LEAST_OFFSET["10-Q"])
    usual_pass = (F.col("span") >= least_span) & (~early | cue)
    loose_pass = ~annual & (F.col("span") >= LOOSE_SPAN) & ((at >= LOOSE_OFFSET) | loose)
    bare_pass = ~annual & ~titled & (F.col("span") >= LOOSE_SPAN) & ((at >= BARE_OFFSET) | loose) & F.get("heads", F.lit(2))
    turn = F.when(titled & usual_pass, 0).when(~titled & usual_pass & F.get("heads", F.lit(0)), 1).when(loose_pass & (titled | F.get("heads", F.lit(1))), 2).when(bare_pass, 3)
    place = F.when(titled, F.col("number")).otherwise(99)  # titles come before bare items in a pass
    found = held.withColumn("turn", turn).where("turn is not null")
    order = F.struct("turn", -F.col("span"), place, at)
    best = found.groupBy("key").agg(F.min_by(F.struct("form", "at", "end", "label", "cue"), order).alias("b"))
    start = F.col("b.at")
    early = start < F.when(F.col("b.form") == "10-K", LEAST_OFFSET["10-K"]).otherwise(LEAST_OFFSET["10-Q"])
    confidence = F.when(~F.col("b.cue"), "low").when(early, "medium").otherwise("high")
    return best.select("key", start.alias("start"), F.col("b.end.at").alias("end"), F.col("b.label").alias("start_label"), F.col("b.end.label").alias("end_label"), confidence.alias("confidence"))


# fixed values: headings of the statements and of their notes, and where the notes end (pattern, from what distance)
STATEMENTS_10Q = [
    r"\bITEM\s+1[.—-]\s*FINANCIAL\s+STATEMENTS\b", r"\bITEM\s+1[.—-]\s*(?:UNAUDITED\s+)?CONDENSED\s+CONSOLIDATED\s+FINANCIAL\s+STATEMENTS\b", r"\bITEM\s+1[.—-]\s*(?:UNAUDITED\s+)?FINANCIAL\s+STATEMENTS\b",
    r"\bPART\s+I[\s,]+ITEM\s+1\b", r"\bCONDENSED\s+CONSOLIDATED\s+FINANCIAL\s+STATEMENTS\b",
]
NOTES = [
    r"\bNotes\s+to\s+Consolidated\s+Financial\s+Statements\b", r"\bNotes\s+to\s+Financial\s+Statements\b", r"\bNotes\s+to\s+Condensed\s+Consolidated\s+Financial\s+Statements\b", r"\bNotes\s+to\s+Unaudited\s+Condensed\s+Consolidated\s+Financial\s+Statements\b",
    r"\bNotes\s+to\s+Unaudited\s+Financial\s+Statements\b", r"\bNotes\s+to\s+Condensed\s+Financial\s+Statements\b", r"\bNotes\s+to\s+Interim\s+Financial\s+Statements\b",
]
NOTES_END = {
    "10-K": [(r"\bITEM\s+9[.—-]\s*", 100), (r"\bITEM\s+15[.—-]", 100), (r"\bPART\s+IV\b", 100), (r"\bSIGNATURES?\b", 100), (r"\bEXHIBIT\s+INDEX\b", 100)],
    "10-Q": [(r"\bPART\s+II\b", 80), (r"\bPART\s+III\b", 80), (r"\bSIGNATURES?\b", 120), (r"\bITEM\s+6[.—–-]", 80)],
}
LONGEST_NOTES, LEAST_NOTES, NOTES_AFTER, NOTES_FROM_10Q = 900_000, 200, 80, 1800
LATE_10K, LATE_10Q, LOOSE_LATE_10Q = 35_000, 4500, 2000


def notes_of(text: str, form: str) -> tuple[int, int, bool] | None:
    """Start and end of the notes to the statements, and whether their heading was found."""
    at = lambda p, least=0: [m.start() for m in re.finditer(p, text, _FLAGS) if m.start() >= least]
    if form == "10-K":
        hits = [x for x in at(r"\bITEM\s+8[.—-]\s*FINANCIAL\s+STATEMENTS\b") if not _cited(text, x)]
        anchor = next((x for x in hits if x > LATE_10K), hits[0] if hits else None)
    else:
        hits = sorted(x for p in STATEMENTS_10Q for x in at(p))
        anchor = next((x for least in (LATE_10Q, LOOSE_LATE_10Q, 0) for x in hits if x >= least), None)

    def bounds(least: int, otherwise: int | None) -> tuple[int, int, bool] | None:
        heads = [x for p in NOTES for x in at(p, least)]
        start = min(heads) if heads else otherwise
        if start is None:
            return None
        start = min(start, len(text))
        stops = [m.start() for p, near in NOTES_END[form] if (m := re.compile(p, _FLAGS).search(text[start:])) and m.start() > near]
        end = start + min([*stops, len(text) - start, LONGEST_NOTES])
        return (start, end, bool(heads)) if end > start + LEAST_NOTES else None

    found = bounds(anchor, anchor + NOTES_AFTER) if anchor is not None else None
    return found or (bounds(NOTES_FROM_10Q, None) if form == "10-Q" else None)


def notes_bounds(df: DataFrame, key: str = "key", text: str = "text", form: str = "form") -> DataFrame:
    """One row per text that has notes to the statements: key, start, end, heading_found. The notes begin at their
    heading after the statements' (late ones before early ones, as contents come first), or 80 characters after that;
    quarterly reports without either take any heading past the contents. Notes of 200 characters or fewer don't count.
    form other than 10-K counts as 10-Q; a null text is empty."""
    ship(df.sparkSession)
    form_ = F.when(F.coalesce(F.col(form), F.lit("")).contains("10-K"), "10-K").otherwise("10-Q")

    @F.udf("start long, end long, heading_found boolean", useArrow=True)
    def find(text: str | None, form: str):
        return notes_of(text or "", form)

    return df.select(F.col(key).alias("key"), find(F.col(text), form_).alias("b")).where("b is not null").select("key", "b.*")


# fixed values: least points of a note on segments, by confidence; its keywords; characters around the first of them
SEGMENTS_HIGH, SEGMENTS_MEDIUM, SEGMENTS_OTHER, BY_KEYWORD = 55, 32, -50, 44
SEGMENT_KEYWORDS = (
    r"\b(?:Operating\s+Segments?|Segment\s+Information|Segments?\s+and\s+Geographic(?:\s+Information)?|Geographic\s+Information|Disaggregated\s+(?:Net\s+)?Revenue"
    r"|Revenue\s+by\s+(?:Operating\s+)?Segment|Revenue\s+by\s+Geograph|Business\s+Segments?|Reportable\s+Segments?)\b"
)
KEYWORD_BEFORE, KEYWORD_SPAN, KEYWORD_LEAST = 700, 200_000, 400
HEADING_CHARS, BODY_CHARS = 220, 4500


def note_blocks(text: str, start: int, end: int) -> list[dict]:
    """Blocks of the notes between start and end: each begins at "Note 5" or "(5) " and ends at the next "Note", or the
    next bracketed number above its own; years in brackets don't count."""
    part = text[start:end]
    begins = {m.start(): (float("inf"), int(m[1])) for m in re.finditer(r"\((?:\s*)(\d{1,3})[A-Za-z]?\s*\)\s+", part, re.A) if 1 <= int(m[1]) <= 999}
    begins = {at: (number, number) for at, (_, number) in begins.items()}
    begins |= {m.start(): (float("inf"), int(m[1])) for m in re.finditer(r"\b(?:Note|NOTE)\s+(\d+)[A-Za-z]?\b", part, re.A)}
    order = sorted(begins)
    out, rising = [], []  # rising: later blocks, nearest first, each with a number above all nearer ones
    for at in reversed(order):
        strength, number = begins[at]
        low, high = 0, len(rising)  # rising[-1] is the nearest
        while low < high:
            mid = (low + high) // 2
            if rising[mid][0] > number:
                low = mid + 1
            else:
                high = mid
        stop = rising[low - 1][1] if low else len(part)
        out.append({"start": start + at, "end": start + stop, "heading": " ".join(part[at : min(at + HEADING_CHARS, stop)].split()), "body": part[at : min(at + BODY_CHARS, stop)]})
        while rising and rising[-1][0] <= strength:
            rising.pop()
        rising.append((strength, at))
    return out[::-1]


def segment_bounds(df: DataFrame, notes: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """The note on segments within each text's notes (key, start, end as notes_bounds() gives them): key, start, end,
    points, confidence (high, medium or low by points). The block with most points, the first on ties; blocks on other
    subjects don't count. Without one, the stretch around the first of the keywords, medium."""
    ship(df.sparkSession)

    @F.udf("array<struct<start:long,end:long,heading:string,body:string>>", useArrow=True)
    def blocks(text: str | None, start: int, end: int):
        return note_blocks(text or "", start, end)

    @F.udf("long", useArrow=True)
    def keyword(text: str | None, start: int, end: int):
        m = re.compile(SEGMENT_KEYWORDS, _FLAGS).search((text or "")[start:end])
        return start + m.start() if m else None

    held = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(notes.select("key", F.col("start").alias("from"), F.col("end").alias("to")), "key")
    block = held.select("key", F.posexplode(blocks(F.col("text"), F.col("from"), F.col("to"))).alias("i", "b"))
    scored = block.select("key", "i", "b.start", "b.end", scores.segment_note(F.col("b.heading"), F.col("b.body"))["total"].alias("points")).where(F.col("points") >= SEGMENTS_OTHER)
    best = scored.groupBy("key").agg(F.max_by(F.struct("start", "end", "points"), F.struct(F.col("points"), -F.col("i"))).alias("b"))
    at = F.col("at")
    around = held.join(best, "key", "left_anti").select("key", "from", "to", keyword(F.col("text"), F.col("from"), F.col("to")).alias("at")).where(at.isNotNull())
    around = around.select("key", F.greatest(F.col("from"), at - KEYWORD_BEFORE).alias("start"), F.least(F.col("to"), at + KEYWORD_SPAN).alias("end")).where(F.col("end") > F.col("start") + KEYWORD_LEAST)
    confidence = F.when(F.col("points") >= SEGMENTS_HIGH, "high").when(F.col("points") >= SEGMENTS_MEDIUM, "medium").otherwise("low")
    return best.select("key", "b.*").unionByName(around.withColumn("points", F.lit(float(BY_KEYWORD)))).withColumn("confidence", confidence)


# --- tables and zones ---

class _Flat(HTMLParser):
    """Visible text with single spaces, and the offset and rows of every table in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.length, self.hidden = 0, 0
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append({"at": self.length, "rows": []})
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]["rows"]:
            self.open[-1]["rows"][-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        told = "" if self.hidden else " ".join(data.split())
        if told:
            self.parts.append(told)
            self.length += len(told) + (self.length > 0)
            if self.open and self.open[-1]["rows"] and self.open[-1]["rows"][-1]:
                cells = self.open[-1]["rows"][-1]
                cells[-1] = f"{cells[-1]} {told}".strip()


def flat_page(html: str) -> tuple[str, list[tuple[int, list[list[str]]]]]:
    p = _Flat()
    p.feed(html)
    p.close()
    return " ".join(p.parts), [(t["at"], t["rows"]) for t in p.tables]


def flatten_pages(df: DataFrame, key: str = "key", html: str = "html") -> DataFrame:
    """key, text (visible text, single spaces) and tables (array of number, at, rows) of each page, in page order. at is the
    length of the text before the table. Tables inside tables are tables of their own. A null page is empty."""
    ship(df.sparkSession)

    @F.udf("text string, tables array<struct<number:int,at:long,rows:array<array<string>>>>", useArrow=True)
    def flat(html: str | None):
        text, tables = flat_page(html or "")
        return {"text": text, "tables": [{"number": i, "at": at, "rows": rows} for i, (at, rows) in enumerate(tables)]}

    return df.select(F.col(key).alias("key"), flat(F.col(html)).alias("f")).select("key", "f.*")


def merge_dollar_cells(row: Column) -> Column:
    """A row's cells (array) with each cell that is only a dollar sign joined to the amount after it."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u00a0\\u2009\\u2007\\u202f\\ufeff]", " "))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("held"))

    def step(acc: Column, cell: Column) -> Column:
        told, last = plain(cell), F.size(acc["out"])
        amount = told.startswith("$") | told.rlike("[0-9]")
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.when(told.startswith("$"), told).otherwise(F.concat(F.lit("$"), told))))
        more = F.concat(acc["out"], F.array(F.coalesce(cell, F.lit(""))))
        return F.when(acc["held"] & amount, F.struct(joined.alias("out"), F.lit(False).alias("held"))).otherwise(F.struct(more.alias("out"), (F.regexp_replace(told, r"\s+", "") == "$").alias("held")))

    return F.aggregate(row, start, step, lambda acc: acc["out"])


def points_in_zones(points: DataFrame, zones: DataFrame, key: str, at: str, start: str, end: str, width: int = 1 << 14) -> DataFrame:
    """Every row of points with every row of zones of the same key whose interval [start, end) holds its place; zones
    may overlap. Columns besides key must differ. Zones are dealt out over the bins of so many places that they cover,
    and points meet the zones of their bin, so a key with very many points is split by place. Nulls meet nothing."""
    bin_ = lambda c: F.floor(c / width)
    spread = zones.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(bin_(F.col(start)), bin_(F.col(end) - 1))))
    return points.withColumn("__bin", bin_(F.col(at))).join(spread, [key, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def table_zones(pages: DataFrame, key: str = "key", html: str = "html", form: str = "form", uncertain: bool = False, width: int = 1 << 14) -> DataFrame:
    """One row per table of a page and zone that it begins in: key, number, at, rows (its grid), zone (discussion or
    segments), confidence. Zones may overlap; tables outside all zones give no row. Zones of low confidence count only
    with uncertain. pages: key (unique), html, form."""
    flat = flatten_pages(pages, key, html)
    forms = pages.select(F.col(key).alias("key"), F.col(form).alias("form"))
    texts = flat.select("key", "text").join(forms, "key")
    kept = lambda df, zone: df.where(F.lit(uncertain) | (F.col("confidence") != "low")).select("key", "start", "end", F.lit(zone).alias("zone"), "confidence")
    zones = kept(discussion_bounds(texts), "discussion").unionByName(kept(segment_bounds(texts, notes_bounds(texts)), "segments"))
    tables = flat.select("key", F.explode("tables").alias("t")).select("key", "t.*")
    return points_in_zones(tables, zones, "key", "at", "start", "end", width).select("key", "number", "at", "rows", "zone", "confidence")
