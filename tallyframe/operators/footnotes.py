"""The debt footnote of a filing: candidates by independent paths over its notes, merged, scored, ranked and classed.

A filing's notes are rows. Each path makes candidates with the bounds of a note: the map of all notes, anchors of debt tables,
tagged text blocks (over their chains of continuations), report pages of the filing summary; labels of the balance sheet
and patterns of prior periods add to what others found. Candidates of one note are merged by greatest sub-score and
united paths before one ranking. Texts are looked for by joins on a word, not by comparing all pairs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scores
from tallyframe.functions import text as tx
from tallyframe.functions.rules import additive
from tallyframe.session import Scratch, ship

# fixed values: points of headings
HEADING = [
    (r"\bdebt\b", 50), (r"\bborrowings?\b", 45), (r"\bindebtedness\b", 45), (r"\bcredit\s+facilities\b", 40), (r"\bcredit\s+facility\b", 40), (r"\bnotes?\s+payable\b", 40), (r"\bbenior\s+notes?\b", 35), (r"\bconvertible\s+notes?\b|\bexchangeable\s+notes?\b", 35),
    (r"\bterm\s+loans?\b", 35), (r"\bfinancing\s+arrangements\b", 35), (r"\bfinance\s+lease\s+obligations\b|\bdebt\s+and\s+finance\s+lease\b", 25), (r"\bsecuritization\s+debt\b", 40),
]
HEADING_MOST = 130
NEGATIVE_HEADING = [
    (r"\bincome\s+tax", 50), (r"\brevenues?\b", 50), (r"\bstockholders?'?\s+equity\b|\bshareholders?'?\s+equity\b", 50), (r"\bearnings\s+per\s+share\b|\beps\b", 40), (r"\bstock\s+compensation\b|\bshare[\s-]?based\b|\bstock(?:\s+|-)?based\s+compensation\b", 40), (r"\bpension\b|\bretirement\b", 40),
]
# fixed values: points of terms in the body ("benior" is how the rules spell it)
BODY = [
    (r"\bcredit\s+agreement\b", 20), (r"\brevolving\s+credit\s+facility\b", 20), (r"\bterm\s+loan\b", 20), (r"\bbenior\s+notes?\b", 20), (r"\bsecured\s+notes?\b", 20), (r"\bunsecured\s+notes?\b", 20), (r"\bnotes?\s+payable\b", 20), (r"\bborrowings\s+outstanding\b", 15),
    (r"\bprincipal\s+amount\b", 10), (r"\bmaturity\s+date\b", 10), (r"\binterest\s+rate\b", 10), (r"\bcollateral\b", 10), (r"\bguarantors?\b", 10), (r"\bcovenants?\b", 10), (r"\bletters?\s+of\s+credit\b", 10), (r"\bavailability\b", 10), (r"\bdebt\s+issuance\s+costs\b", 10),
    (r"\bunamortized\s+discount\b", 10), (r"\bcurrent\s+portion\s+of\s+long[\s-]*term\s+debt\b", 15), (r"\blong[\s-]*term\s+debt\s*,\s*net\b", 15), (r"\btotal\s+debt\b", 15),
]
# fixed values: labels of lines in a debt table; two of them in one table are evidence
TABLE_LINES = [
    r"\brevolving\s+credit\s+facility\b", r"\bterm\s+loan\b", r"\bbenior\s+secured\s+notes?\b", r"\bbenior\s+unsecured\s+notes?\b", r"\bconvertible\s+notes?\b", r"\bfinance\s+lease\s+obligations\b", r"\btotal\s+debt\b", r"\bless\s*:\s*current\s+portion\b",
    r"\bless\s*:\s*unamortized\s+debt\s+issuance\s+costs\b", r"\blong[\s-]*term\s+debt\s*,\s*net\b",
]
# fixed values: words of a debt table, each occurrence counts
TABLE_WORDS = [
    r"\bdebt\b", r"\bdebentures?\b", r"\bbenior\s+secured\b", r"\bbenior\s+notes?\b", r"\bsubordinated\s+notes?\b", r"\bsecured\s+notes?\b", r"\bunsecured\s+notes?\b", r"\bnotes?\s+payable\b", r"\bcredit\s+facilit(?:y|ies)\b", r"\bcredit\s+agreements?\b",
    r"\brevolving\s+(?:credit\s+)?facility\b", r"\brevolving\s+credit\b", r"\bterm\s+loans?\b", r"\bindentures?\b", r"\bmaturit(?:y|ies)\b", r"\bprincipal\b", r"\boutstanding\b", r"\bcarrying\s+(?:amount|value)\b", r"\blong[\s-]*term\s+debt\b", r"\bshort[\s-]*term\s+debt\b",
    r"\bcovenants?\b", r"\bcollateral\b", r"\blenders?\b", r"\bletters?\s+of\s+credit\b", r"\bborrow(?:ings?|owed)\b", r"\bdeferred\s+financ(?:ing|e)\s+fees\b", r"\bfloating\s+rate\b", r"\beuro[\s-]*denominat\b", r"\bond\s+discount\b", r"\bunamortized\b", r"\bdebt\s+issuance\b",
    r"\bissuance\s+costs?\b", r"\bunamortized\s+(?:debt\s+)?issuance\s+costs?\b", r"\bunamortized\s+(?:discount|premium)s?\b", r"\b(?:discount|premium)s?\s+on\s+debt\b",
]
# fixed values: terms whose presence in the body indicates debt
INDICATORS = [
    "revolving credit facility", "credit agreement", "term loan", "senior notes", "secured notes", "unsecured notes", "notes payable", "maturity", "maturity date", "interest rate", "principal amount", "outstanding", "borrowings", "lender", "collateral", "covenant", "compliance", "letters of credit",
    "availability", "amortization", "debt issuance costs", "unamortized discount", "current portion of long-term debt", "long-term debt", "finance lease obligations", "weighted average interest rate", "total debt", "indenture", "credit facility", "borrowings outstanding", "debt obligations",
    "convertible notes", "revolving credit",
]
TABLE_HINTS, HINT_COUNT = r"\b(?:total\s+debt|less:\s*current\s+portion|senior\s+secured\s+notes|finance\s+lease\s+obligations)\b", 2
# fixed values: anchors of debt tables
ANCHORS = [
    r"\btotal\s+debt\b", r"\blong[\s-]*term\s+debt\s*,\s*net\b", r"\blong[\s-]*term\s+debt\b", r"\bcurrent\s+portion\s+of\s+long[\s-]*term\s+debt\b", r"\bcurrent\s+maturities\s+of\s+long[\s-]*term\s+debt\b", r"\bshort[\s-]*term\s+borrowings\b", r"\bnotes?\s+payable\b",
    r"\brevolving\s+credit\s+facility\b", r"\bterm\s+loan\s+facility\b", r"\bbenior\s+secured\s+notes?\b", r"\bbenior\s+unsecured\s+notes?\b", r"\bbenior\s+notes?\b", r"\bsecured\s+notes?\b", r"\bunsecured\s+notes?\b", r"\bconvertible\s+notes?\b", r"\bfinance\s+lease\s+obligations\b",
    r"\bless\s*:\s*unamortized\s+debt\s+issuance\s+costs\b", r"\bless\s*:\s*current\s+portion\b", r"\bless\s*:\s*current\s+maturities\b", r"\bdebt\s+issuance\s+costs\b", r"\bunamortized\s+discount\b", r"\bborrowings\s+outstanding\b",
]
# fixed values: headings that are clearly about debt
CLEAR_HEADING = [
    r"\bdebt\b", r"\blong[\s-]*term\s+debt\b", r"\bshort[\s-]*term\s+debt\b", r"\bborrowings?\b", r"\bindebtedness\b", r"\bnotes?\s+payable\b", r"\bbenior\s+notes?\b", r"\bsecured\s+notes?\b", r"\bunsecured\s+notes?\b", r"\bcredit\s+facilit(?:y|ies)\b", r"\brevolving\s+(?:credit|facility)\b", r"\bterm\s+loans?\b",
    r"\bloans?\s+payable\b", r"\bfinancing\s+arrangements\b", r"\bdebt\s+obligations\b", r"\bdebt\s+and\s+financing\s+obligations\b", r"\bdebt\s*,\s*net\b", r"\bdebt\s+and\s+(?:finance|capital)\s+lease\b", r"\bconvertible\s+notes?\b", r"\bexchangeable\s+notes?\b", r"\bsecuritization\s+debt\b",
    r"\bfinancing\s+liabilit", r"\bdebentures?\b", r"\bvariable\s+interest\s+entit(?:y|ies)\s+debt\b",
]
# fixed values: headings of other sections
WRONG_HEADING = [r"\brisk\s+factors\b", r"\bexhibit\s+index\b", r"\bquantitative\s+and\s+qualitative\s+disclosures\s+about\s+market\s+risk\b"]
# fixed values: labels of debt on a balance sheet
SHEET_LABELS = [
    "short-term debt", "short term debt", "current portion of long-term debt", "current portion of long term debt", "current maturities of long-term debt", "current maturities of long term debt", "long-term debt", "long term debt", "long-term debt, net", "notes payable", "borrowings",
    "finance lease liabilities", "finance lease obligation", "debt, net",
]
# fixed values: concepts of tagged blocks on debt
DEBT_CONCEPT = "(?i)Debt|LongTermDebt|Borrowings|NotesPayable|CreditFacility|ConvertibleDebt|ExchangeableDebt|FinanceLease|FinancingArrangements|DebtAndFinanceLeaseObligations|BorrowingsOutstanding|FinancingLiabilit|SeniorNotes|RevolvingCredit|TermLoan"
# fixed values: strength of the way a candidate was found
METHODS = {"filing_summary_report": 5, "ixbrl_textblock": 4, "debt_table_anchor": 3, "note_map": 1}
SUMMARY_POINTS, STANDALONE_POINTS, TAGGED_MOST, TITLE_BONUS = 46.0, 40.0, 85.0, 96.0


def plain(text: Column) -> Column:
    """Text as patterns expect it: lower case, plain dashes and quotes, entities decoded, single spaces."""
    for entity, told in (("(?i)&nbsp;|&#160;|\\u00a0", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&"), ("[\\u2012\\u2013\\u2014\\u2015]", "-"), ("[\"\\u201c\\u201d\\u2018\\u2019]", "'")):
        text = F.regexp_replace(text, entity, told)
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(patterns))


def heading_points(heading: Column) -> Column:
    return additive([(heading.rlike(p), float(n)) for p, n in HEADING], high=float(HEADING_MOST))


def body_points(body: Column) -> Column:
    """Struct of points and number of the terms that a body holds."""
    hits = [body.rlike(p) for p, _ in BODY]
    return F.struct(additive([(h, float(n)) for h, (_, n) in zip(hits, BODY)]).alias("points"), additive([(h, 1.0) for h in hits]).cast("int").alias("terms"))


def table_points(tables: Column) -> Column:
    """30 if a table (of an array of plain texts) has two of the lines of debt tables, 12 for one, else 0."""
    most = F.coalesce(F.array_max(F.transform(tables, lambda t: additive([(t.rlike(p), 1.0) for p in TABLE_LINES]))), F.lit(0.0))
    return F.when(most >= 2, 30.0).when(most == 1, 12.0).otherwise(0.0)


def table_words(tables: Column) -> Column:
    """The most words of debt in one table; tables of under 36 characters don't count."""
    count = lambda t: sum((F.regexp_count(t, F.lit(p)) for p in TABLE_WORDS), F.lit(0))
    return F.coalesce(F.array_max(F.transform(F.filter(tables, lambda t: F.length(t) >= 36), count)), F.lit(0))


def negative_points(heading: Column, body: Column, table: Column, terms: Column) -> Column:
    """Points against a note: other subjects by heading, other sections by heading or by the body's beginning."""
    no = lambda p: ~heading.rlike(p)
    lead = F.substring(body, 1, 3200)
    leases = heading.rlike(r"\bleases?\b") & no(r"\bdebt\b") & no(r"\bfinance\s+lease\b") & no(r"\bdebt\s+and\b")
    fair = heading.rlike(r"\bfair\s+value\b") & no(r"\bdebt\b") & no(r"\bborrowings?\b")
    goodwill = heading.rlike(r"\bgoodwill\b|\bintangible\s+assets\b") & no(r"\bdebt\b")
    misplaced = F.substring(body, 1, 1600).rlike(r"\baccumulated\s+other\s+comprehensive\b") & ~F.substring(body, 1, 2000).rlike(r"\bgoodwill\b")
    liquidity = r"\bliquidity\s+and\s+capital\s+resources\b"
    pasted = lead.rlike(liquidity) & ~F.substring(body, 1, 700).rlike(r"\bnotes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements\b")
    return additive(
        [(heading.rlike(p), float(n)) for p, n in NEGATIVE_HEADING]
        + [(leases & (terms < 2) & (table < 30), 20.0), (fair & (table < 30), 20.0), (goodwill & misplaced, 135.0), (heading.rlike(liquidity) | pasted, 100.0)]
        + [(heading.rlike(p), 100.0) for p in (*WRONG_HEADING, r"\bcontrols\s+and\s+procedures\b")]
    )


def sheet_labels(text: Column) -> Column:
    """The debt labels that a balance sheet's plain text holds; operating leases only where there is no other."""
    found = F.filter(F.array(*map(F.lit, SHEET_LABELS)), lambda x: text.contains(x))
    only = text.contains("operating lease liabilities") & ~text.contains("long-term debt") & ~text.contains("notes payable")
    return F.when((F.size(found) == 0) & only, F.array(F.lit("operating lease liabilities"))).otherwise(found)


def sheet_points(body: Column, labels: Column) -> Column:
    """14 for each label (array) that a body holds, at most 52."""
    return F.least(F.lit(52.0), 14.0 * F.size(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: body.contains(x))))


def prior_points(heading: Column, number: Column, body: Column, patterns: Column) -> Column:
    """The best fit of a note to the debt notes of prior periods (array of heading, number, labels): 38 for the
    heading, 28 for a number at most 2 away, 10 for each label of 8 characters or more; at most 58."""
    digits = lambda c: F.try_to_number(F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")), F.lit("999999999")).cast("int")

    def points(p: Column) -> Column:
        told = F.lower(F.trim(F.regexp_replace(F.regexp_replace(p["heading"], "\\u00a0", " "), r"\s+", " ")))
        named = (F.length(told) >= 6) & (heading.contains(F.substring(told, 1, 48)) | told.contains(F.substring(heading, 1, 48)))
        near = F.abs(digits(p["number"]) - digits(number)) <= 2
        labels = F.size(F.filter(p["labels"], lambda x: (F.length(F.trim(x)) >= 8) & body.contains(F.lower(F.trim(x)))))
        return additive([(named, 38.0), (near, 28.0)]) + 10.0 * labels

    return F.least(F.lit(58.0), F.coalesce(F.array_max(F.transform(patterns, points)), F.lit(0.0)))


# --- tagged blocks and their continuations ---

def follow_chains(heads: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """The nodes that each head leads to, in order: key, head, rank (from 1), id. heads: key, head (unique within key),
    next; links: key, id, next (id unique within key; null: the end). A chain ends at a node that is missing or was
    passed before, so cycles end. Several heads may lead to one node.

    Pointers are doubled by joins, so chains of n nodes take log2(n) rounds, each written to the shared folder. Rounds
    over the nodes tell first how many nodes follow each (in a cycle: all its others); then every node of a head's chain
    is made by one join, the far ones first, and is not read again to find repeated ones."""
    scratch = Scratch(heads.sparkSession, "chains")
    there = links.select(key, F.col("id").alias("to"), F.col("id").alias("found"))
    all_ = links.select(key, "id", F.col("next").alias("to")).join(there, [key, "to"], "left").select(key, "id", F.col("found").alias("to"))
    all_ = scratch.write(all_, "links")
    hops, ends = _count_after(all_.where("to is not null"), all_.where("to is null").select(key, "id", F.lit(0).cast("long").alias("left")), key, scratch, "hops")
    if not hops[-1].isEmpty():  # these lead into cycles
        turns, more = _count_in_cycles(all_.where("to is not null").join(hops[-1].select(key, "id"), [key, "id"]), key, scratch)
        hops, ends = hops + turns[len(hops) :], ends + more
    begin = heads.select(key, "head", F.col("next").alias("id")).join(reduce(DataFrame.unionByName, ends), [key, "id"])
    path = _walk(begin.select(key, "head", F.lit(1).cast("long").alias("rank"), "id", "left"), hops, key, scratch, "path")
    scratch.drop(*[x for x in scratch.paths if not x.startswith("path")])
    return path


def _count_after(hop: DataFrame, ends: DataFrame, key: str, scratch: Scratch, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """hop: key, id, to (a node of hop or of ends); ends: key, id, left. The hops of 2^r nodes of those nodes that don't
    come to ends within them (the last: those that never do), and the ends with the nodes that do and their left, the
    number of nodes to an end and the end's own."""
    hops, found = [hop], [ends]
    while not hops[-1].isEmpty():
        r = len(hops)
        state = reduce(DataFrame.unionByName, found).withColumn("end", F.lit(None).cast(hop.schema["to"].dataType)).unionByName(hops[-1].select(key, "id", F.lit(None).cast("long").alias("left"), F.col("to").alias("end")))
        step = scratch.write(hops[-1].join(state.withColumnRenamed("id", "to"), [key, "to"]).select(key, "id", F.col("end").alias("to"), (F.col("left") + (1 << (r - 1))).alias("left")), f"{name}{r}")
        ended = step.where("to is null").select(key, "id", "left")
        if ended.isEmpty():  # the nodes before an end have one number after the other, so no more come to ends
            break
        found.append(ended)
        hops.append(step.where("to is not null").select(key, "id", "to"))
    return hops, found


def _count_in_cycles(hop: DataFrame, key: str, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """hop: key, id, to of nodes that lead into cycles. Their hops of 2^r nodes, as far as walks need them, and tables of
    key, id, left: the number of other nodes that a walk from the node passes."""
    step = scratch.write(hop.select(key, "id", "to", F.col("to").alias("least"), F.lit(1).cast("long").alias("at"), F.lit(False).alias("same")), "turns0")
    turns, on = [step], lambda t: t.select(key, F.col("id").alias("to"), F.col("to").alias("end"), *[F.col(c).alias(f"on_{c}") for c in t.columns if c in ("least", "at")])
    while not step.where("not same").isEmpty():  # least: of the next 2^r nodes; at: how far it is
        lower = F.col("on_least") < F.col("least")
        step = step.join(on(step), [key, "to"]).select(key, "id", F.col("end").alias("to"), F.least("least", "on_least").alias("least"), F.when(lower, F.col("on_at") + (1 << (len(turns) - 1))).otherwise(F.col("at")).alias("at"), (~lower).alias("same"))
        step = scratch.write(step, f"turns{len(turns)}")
        turns.append(step)
    # the least node of a cycle is the one that comes first after itself; at is the length of its cycle then
    first = step.where("least = id").select(key, F.col("id").alias("head"), F.lit(1).cast("long").alias("rank"), "id", (F.col("at") - 1).alias("left"))
    turns = [t.select(key, "id", "to") for t in turns]
    sizes = first.select(key, "head", "left")
    cycles = scratch.write(_walk(first, turns, key, scratch, "cycle").join(sizes, [key, "head"]).select(key, "id", "left"), "cycles")
    tails = scratch.write(hop.join(cycles, [key, "id"], "left_anti").select(key, "id", "to"), "tails0")
    found = [cycles] if tails.isEmpty() else _count_after(tails, cycles, key, scratch, "tails")[1]
    most = reduce(DataFrame.unionByName, found).agg(F.max("left")).first()[0]
    while 1 << len(turns) <= most:
        turns.append(scratch.write(turns[-1].join(on(turns[-1]), [key, "to"]).select(key, "id", F.col("end").alias("to")), f"turns{len(turns)}"))
    return turns, found


def _walk(begin: DataFrame, hops: list[DataFrame], key: str, scratch: Scratch, name: str) -> DataFrame:
    """key, head, rank, id of the first nodes (begin: key, head, rank, id, left) and of as many nodes after them as left
    says. A row stands for itself and the nodes after it that aren't there yet."""
    path = scratch.write(begin, f"{name}-first")
    most = path.agg(F.max("left")).first()[0] or 0
    for r in reversed(range(most.bit_length())):
        far = 1 << r
        more = path.where(F.col("left") >= far).join(hops[r], [key, "id"])
        path = path.unionByName(scratch.write(more.select(key, "head", (F.col("rank") + far).alias("rank"), F.col("to").alias("id"), (F.least("left", F.lit(2 * far - 1)) - far).alias("left")), f"{name}{r}"))
    return path.drop("left")


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))


def _untagged(text: Column) -> Column:
    for pattern, told in (("<[^>]+>", " "), ("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        text = F.regexp_replace(text, pattern, told)
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def normal_text(text: Column) -> Column:
    """A block's text as it is compared with notes: lower case, without tags, entities decoded, single spaces."""
    return F.lower(_untagged(text))


def tagged_blocks(filings: DataFrame, key: str = "key", html: str = "html") -> DataFrame:
    """One row per tagged text block on debt in each filing's markup: key, block (its place), concept, text (with its
    continuations in order, tags taken away), disclosure. Blocks of under 36 characters don't count; of continuations
    with one id the last stands. A null filing has none."""

    def elements(name: str) -> DataFrame:
        whole = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<ix:{name}\b[^>]*>.*?</ix:{name}>"), F.lit(0))
        rows = filings.select(F.col(key).alias("key"), F.posexplode(whole).alias("at", "m"))
        tag = F.regexp_extract("m", r"(?s)^<[^>]*>", 0)
        inner = F.regexp_replace(F.regexp_replace("m", r"(?s)^<[^>]*>", ""), rf"(?is)</ix:{name}>$", "")
        return rows.select("key", "at", _attribute(tag, "id").alias("id"), _attribute(tag, "continuedAt").alias("next"), _attribute(tag, "name").alias("concept"), _untagged(inner).alias("text"))

    scratch = Scratch(filings.sparkSession, "tagged")
    parts = elements("continuation").where("id is not null").groupBy("key", "id").agg(F.max_by(F.struct("next", "text"), "at").alias("f")).select("key", "id", "f.*")
    parts = scratch.write(parts, "parts")
    heads = scratch.write(elements("nonNumeric").where(F.col("concept").rlike(DEBT_CONCEPT)).select("key", F.col("at").alias("head"), "next", "concept", "text"), "heads")
    path = follow_chains(heads.where("next is not null"), parts.select("key", "id", "next"), "key")
    told = path.join(parts.select("key", "id", F.col("text").alias("more")), ["key", "id"]).groupBy("key", "head").agg(F.array_sort(F.collect_list(F.struct("rank", "more"))).alias("parts"))
    text = F.trim(F.regexp_replace(F.array_join(F.concat(F.array("text"), F.coalesce(F.transform("parts", lambda p: p["more"]), F.array().cast("array<string>"))), " "), r"\s+", " "))
    out = heads.join(told, ["key", "head"], "left").select("key", F.col("head").alias("block"), "concept", text.alias("text"), F.col("concept").rlike("(?i)textblock|disclosure").alias("disclosure"))
    return out.where(F.length(F.lower(_untagged(F.col("text")))) >= 36)


# --- notes and candidates ---

_HEADING = re.compile(r"^[ \t]*(?:note|NOTE|Note)[ \t]+(\d{1,3}[A-Za-z]?)\b[ \t]*[-–—:.]*[ \t]*([^\n]*)$", re.M | re.A)
_TABLE = re.compile(r"(?:^[ \t]*\|[^\n]*(?:\n|\Z))+", re.M)


def notes_in(text: str, start: int, end: int) -> list[dict]:
    """Notes of a filing's text between two offsets: each goes from its heading's line to the next one."""
    hits = list(_HEADING.finditer(text, start, end))
    out = []
    for m, after in zip(hits, [*hits[1:], None]):
        to = after.start() if after else end
        body = text[m.start() : to]
        out.append({"note": m[1], "heading": m[0].strip(), "start": m.start(), "end": to, "body": body, "tables": _TABLE.findall(body)})
    return out


def filing_notes(filings: DataFrame, key: str = "key", text: str = "text", bounds: DataFrame | None = None) -> DataFrame:
    """One row per note: key, note (number), heading, start, end (offsets), body, tables (runs of piped lines). A note
    starts at a line "Note 5 - Title". bounds (key, start, end) limits the search to the notes of each filing that it
    has; other filings are searched whole. Null texts have none; whole texts are searched."""
    ship(filings.sparkSession)

    @F.udf("array<struct<note:string,heading:string,start:long,end:long,body:string,tables:array<string>>>", useArrow=True)
    def notes(text: str | None, start: int | None, end: int | None):
        text = text or ""
        return notes_in(text, start or 0, len(text) if end is None else end)

    rows = filings.select(F.col(key).alias("key"), F.col(text).alias("text"))
    none = F.lit(None).cast("long")
    rows = rows.withColumns({"from": none, "to": none}) if bounds is None else rows.join(bounds.select("key", F.col("start").alias("from"), F.col("end").alias("to")), "key", "left")
    return rows.select("key", F.explode(notes("text", "from", "to")).alias("n")).select("key", "n.*")


def _holding(texts: DataFrame, notes: DataFrame, probe: str) -> DataFrame:
    """Rows of texts with each note of the same key that may hold the probe: by a word of it, or by the key alone for
    probes without a whole word."""
    keyed = texts.withColumn("word", tx.inner_word(F.col(probe)))
    words = notes.select("key", "start", F.explode(F.array_distinct(F.split("body_", " "))).alias("word"))
    by_word = keyed.where("word is not null").join(words, ["key", "word"]).drop("word")
    rest = keyed.where("word is null").drop("word").join(notes.select("key", "start"), "key")
    return by_word.unionByName(rest).join(notes.select("key", "start", "body_"), ["key", "start"])


def _first_holding(texts: DataFrame, notes: DataFrame, id_: list[str], text: str) -> DataFrame:
    """For each text the first note that holds its first 80 characters: the ids, key, start."""
    probe = F.substring(plain(F.col(text)), 1, 200)
    stubs = texts.withColumn("stub", F.substring(probe, 1, 80)).where(F.length(probe) >= 28).select("key", *id_, "stub")
    return _holding(stubs, notes, "stub").where(F.col("body_").contains(F.col("stub"))).groupBy("key", *id_).agg(F.min("start").alias("start"))


def debt_footnotes(notes: DataFrame, blocks: DataFrame | None = None, reports: DataFrame | None = None, sheets: DataFrame | None = None, priors: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per filing with notes: key, note, heading, start, end, the sub-scores, total, confidence, method, paths
    (sorted), n_candidates, runner_up (the next total; null for none).

    notes: as filing_notes() gives them. blocks: key, block, text, disclosure (tagged_blocks()). reports: key, report,
    text (pages of the filing summary). sheets: key, labels (array, sheet_labels()). priors: key, patterns (array of
    heading, number, labels). found: keys whose heading of the notes was found; without it all count as found.

    Notes of under 55 characters that aren't blank are left out, unless a filing has no other. Ranking: total, 96 more for a heading
    "note n debt"; then total; then the earlier note. A filing's notes are few; texts of any length are searched."""
    spark = notes.sparkSession
    scratch = Scratch(spark, "footnotes")
    heading, body = F.col("heading_"), F.col("body_")
    base = notes.select("key", "note", "heading", "start", "end", plain(F.col("heading")).alias("heading_"), plain(F.col("body")).alias("body_"), F.transform("tables", lambda t: plain(F.regexp_replace(t, r"[|]", " "))).alias("tables_"))
    full = (F.size("tables_") > 0) | (F.length(F.regexp_replace(body, r"\s+", "")) >= 55)
    base = base.withColumn("full", full).withColumn("any", F.max("full").over(Window.partitionBy("key"))).where("full or not any")
    scored = base.withColumns({"b": body_points(body), "table": table_points(F.col("tables_")), "words": table_words(F.col("tables_"))})
    indicators = F.size(F.filter(F.array(*map(F.lit, INDICATORS)), lambda x: body.contains(x))) + F.when(body.rlike(TABLE_HINTS), HINT_COUNT).otherwise(0)
    scored = scored.select(
        "key", "note", "heading", "start", "end", "heading_", "body_", "full", heading_points(heading).alias("heading_points"), F.col("b.points").alias("body_points"), F.col("b.terms").alias("terms"), "table", "words",
        negative_points(heading, body, F.col("table"), F.col("b.terms")).alias("negative"), indicators.alias("indicators"), _any(heading, CLEAR_HEADING).alias("clear"), _any(heading, WRONG_HEADING).alias("wrong"), _any(body, ANCHORS).alias("anchor"),
    )
    scored = scratch.write(scored, "notes")

    # points of tagged blocks that lie in a note, and the blocks that lie in none
    candidate = lambda df, path, tagged=0.0, summary=0.0: df.select("key", "start", F.lit(path).alias("path"), F.lit(tagged).alias("tagged"), F.lit(summary).alias("summary"))
    rows = candidate(scored, "note_map").unionByName(candidate(scored.where(F.col("anchor") & F.col("full") & (F.col("end") - F.col("start") >= 140)), "debt_table_anchor"))
    if blocks is not None:
        normal = normal_text(F.col("text"))
        held = blocks.select("key", "block", "text", "disclosure", normal.alias("norm")).withColumn("probe", F.substring("norm", 1, 72))
        one = F.struct(F.col("norm").alias("text"), "disclosure")
        pairs = _holding(held.drop("text"), scored, "probe").select("key", "start", "block", scores.overlap_boost(body, F.array(one)).alias("points")).where("points > 0")
        pairs = scratch.write(pairs, "pairs")
        overlaps = pairs.groupBy("key", "start").agg(F.least(F.lit(TAGGED_MOST), F.sum("points")).alias("tagged"))
        rows = rows.unionByName(overlaps.where("tagged >= 16").select("key", "start", F.lit("ixbrl_textblock").alias("path"), "tagged", F.lit(0.0).alias("summary")))
        rows = rows.unionByName(overlaps.where("tagged < 16").select("key", "start", F.lit(None).cast("string").alias("path"), "tagged", F.lit(0.0).alias("summary")))
        alone = blocks.join(pairs.where("points >= 18").select("key", "block").distinct(), ["key", "block"], "left_anti")
        standing = candidate(_first_holding(alone, scored, ["block"], "text"), "ixbrl_textblock", tagged=STANDALONE_POINTS)
        rows = rows.unionByName(standing.withColumn("standing", F.lit(True)), allowMissingColumns=True)
    else:
        rows = rows.withColumn("standing", F.lit(None).cast("boolean"))
    if reports is not None:
        rows = rows.unionByName(candidate(_first_holding(reports, scored, ["report"], "text"), "filing_summary_report", summary=SUMMARY_POINTS), allowMissingColumns=True)
    # a note that only overlaps keeps its own way; one found by a block alone takes the block's
    way = F.create_map(*[x for k, v in METHODS.items() for x in (F.lit(k), F.lit(v))])
    strength = F.when(F.col("path") == "ixbrl_textblock", F.when(F.col("standing"), METHODS["ixbrl_textblock"]).otherwise(1)).otherwise(F.coalesce(F.try_element_at(way, F.col("path")), F.lit(1)))
    merged = rows.groupBy("key", "start").agg(F.max("tagged").alias("tagged"), F.max("summary").alias("summary"), F.collect_set("path").alias("paths"), F.max(strength).alias("strength"), F.max(F.when(F.col("path") != "debt_table_anchor", strength)).alias("other"))
    out = merged.join(scored, ["key", "start"])
    strength = F.when(F.col("clear") & (F.col("strength") == METHODS["debt_table_anchor"]), F.col("other")).otherwise(F.col("strength"))
    out = out.withColumn("strength", strength)
    out = out.join(sheets.select("key", "labels"), "key", "left") if sheets is not None else out.withColumn("labels", F.lit(None).cast("array<string>"))
    out = out.join(priors.select("key", "patterns"), "key", "left") if priors is not None else out.withColumn("patterns", F.lit(None).cast("array<struct<heading:string,number:string,labels:array<string>>>"))
    out = out.withColumns({"sheet": sheet_points(body, F.col("labels")), "prior": prior_points(heading, F.col("note"), body, F.col("patterns"))})
    more = F.array_compact(F.array(F.when(F.col("sheet") >= 12, F.lit("balance_sheet_crosscheck")), F.when(F.col("prior") >= 22, F.lit("prior_period_learning"))))
    total = F.col("heading_points") + F.col("body_points") + F.col("table") + F.col("tagged") + F.col("summary") + F.col("sheet") + F.col("prior") + F.least(F.lit(22.0), 0.14 * F.col("words")) - F.col("negative")
    out = out.withColumns({"paths": F.array_sort(F.array_union("paths", more)), "total": total})
    shown = ["note", "heading", "start", "end", "heading_points", "body_points", "terms", "table", "words", "tagged", "summary", "sheet", "prior", "negative", "indicators", "total", "paths", "strength", "clear", "wrong"]
    bonus = F.when(heading.rlike(r"\bnote\s+\d{1,2}[a-z]?[\s\-]{0,4}debt\b"), TITLE_BONUS).otherwise(0.0)
    order = F.struct((F.col("total") + bonus).alias("rank"), "total", -F.col("start"))
    best = out.groupBy("key").agg(F.max_by(F.struct(*shown), order).alias("best"), F.count("*").alias("n_candidates"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(order.alias("o"))))), 2, 1).alias("next"))
    best = best.select("key", "best.*", "n_candidates", F.get("next", F.lit(0))["o"]["total"].alias("runner_up"))
    if found is not None:
        best = best.join(found.select("key").distinct().withColumn("notes_found", F.lit(True)), "key", "left").withColumn("notes_found", F.coalesce("notes_found", F.lit(False)))
    else:
        best = best.withColumn("notes_found", F.lit(True))
    numbers = {"total": F.col("total"), "negative": F.col("negative"), "body_terms": F.col("terms"), "indicators": F.col("indicators"), "table_evidence": F.col("table"), "table_keywords": F.col("words"), "paths": F.size("paths")}
    flags = {"notes_found": F.col("notes_found"), "clear_heading": F.col("clear"), "wrong_heading": F.col("wrong"), "anchored": F.col("strength") == METHODS["debt_table_anchor"]}
    method = F.when(F.col("strength") == 3, "debt_table_anchor").when(F.col("strength") == 5, "filing_summary_report").when(F.col("strength") == 4, "ixbrl_textblock").when(F.col("clear"), "direct_heading_match")
    method = method.when((F.col("table") >= 30) | (F.col("words") >= 24), "debt_table_keyword_match").when(F.col("tagged") >= 26, "xbrl_tag_fallback").otherwise("body_keyword_fallback")
    return best.withColumns({"confidence": scores.footnote_confidence(numbers, flags), "method": method}).drop("strength", "clear", "wrong", "notes_found")
