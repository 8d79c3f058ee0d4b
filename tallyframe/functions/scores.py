"""Scores of search results, candidates and headings: points of conditions that hold, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import keep
from tallyframe.functions.classes import found
from tallyframe.functions.rules import additive


def _true(c: Column | None) -> Column:
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


def first_points(parts: list[tuple[Column, float]]) -> Column:
    """The points of the first condition that holds, 0 for none."""
    out = F.lit(0.0)
    for condition, points in reversed(parts):
        out = F.when(_true(condition), F.lit(float(points))).otherwise(out)
    return out


# fixed values: points of ratings results
def ratings_match(title: Column, snippet: Column, url: Column, ticker: str, company: str, aliases: list[str]) -> Column:
    """How well a result fits an issuer, up to 100. ticker, company and aliases are the query's."""
    text = F.lower(F.concat_ws(" ", title, snippet, url))
    holds = lambda x: text.contains(x.lower().strip()) if len(x.strip()) >= 2 else F.lit(False)
    name = company.strip()
    first = name.split()[0] if name else ""
    named = [(holds(name), 25.0), (holds(first) if len(first) >= 3 else F.lit(False), 12.0)] if len(name) >= 3 else []
    other = F.lit(False)
    for a in aliases:
        if len(a) >= 3 and a not in (ticker, name):
            other = other | holds(a)
    total = 25 + F.when(text.contains(ticker.lower()), 28.0).otherwise(0.0) + first_points(named) + F.when(other, 8.0).otherwise(0.0)
    return F.least(F.lit(100.0), total)


def ratings_url(url: Column) -> Column:
    """Points for a path of 11 to 89 characters, less for one of 120 or more and for a query of over 40."""
    path = F.length(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    query = F.length(F.regexp_extract(url, r"(\?[^#]*)", 1))
    is_url = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    return additive([(is_url & path.between(11, 89), 4.0), (is_url & (path >= 120), -3.0), (is_url & (query > 40), -2.0)])


def freshness(days: Column, steps: list[tuple[float, float]]) -> Column:
    """The points of the first step (days, points) that an age is under; null ages get none."""
    return first_points([(days < limit, points) for limit, points in steps])


# fixed values: ages in days and points
RATINGS_AGES = [(365, 12), (3 * 365, 6), (7 * 365, 2)]
NEWSLETTER_AGES = [(14, 10), (60, 6), (365, 2)]


def newsletter_score(confidence: Column, merged: Column, from_feed: Column, likely: Column, publication: Column, days: Column, relevance: Column) -> Column:
    points = additive([(_true(merged), 18.0), (_true(from_feed), 10.0), (_true(likely), 6.0)])
    return keep.js_round(confidence * 100) + points + keep.js_round(F.coalesce(publication, F.lit(0.0)) * 25) + freshness(days, NEWSLETTER_AGES) + relevance


# fixed values: evidence for an affiliate in groups (the first that holds counts), and its points
AFFILIATE_GROUPS = [
    [("exact_root", 25), ("strong_name", 15), ("weak_name", 5)],
    [("headquarters", 30), ("mailing", 20), ("facility", 20), ("city_state", 3)],
    [("officer", 30), ("manager", 25), ("executive", 20)],
    [("same_agent", 10)],
    [("credit_agreement", 35), ("sec_reference", 30), ("registry", 25), ("ucc_or_county", 20)],
    [("finance_pattern", 10)],
    [("property_pattern", 10)],
    [("opco_pattern", 8)],
    [("unrelated_industry", -20)],
    [("unrelated_geography", -10)],
]


def affiliate_score(evidence: dict[str, Column]) -> Column:
    """0 to 100 from flags named as in AFFILIATE_GROUPS, with the caps of generic_agent_only and same_generic_agent (10),
    similar_name_only (25) and no_official_link (44 for scores of 55 or more)."""
    has = lambda name: _true(evidence.get(name))
    total = F.lit(0.0)
    for group in AFFILIATE_GROUPS:
        total = total + first_points([(has(name), points) for name, points in group])
    generic = has("generic_agent_only") | (has("same_generic_agent") & (total <= 10))
    cap = F.when(generic, 10.0).when(has("similar_name_only"), 25.0).otherwise(100.0)
    capped = F.greatest(F.lit(0.0), F.least(cap, total))
    return F.when(has("no_official_link") & (capped >= 55), 44.0).otherwise(capped)


def coverage_quality(recommended: Column, checked: Column, unresolved: Column, several_entities: Column, has_place: Column) -> Column:
    ratio = F.when(recommended > 0, checked / recommended).otherwise(0.0)
    return F.when(several_entities & has_place & (ratio >= 0.5) & (unresolved <= 3), "high").when((ratio >= 0.25) & (has_place | several_entities), "medium").otherwise("low")


def match_confidence(score: Column, override: Column) -> Column:
    """high, medium, low or unresolved by a name's score; a confirmed or rejected override decides alone."""
    return (
        F.when(override == "confirmed", "high").when(override == "rejected", "unresolved")
        .when(score >= 0.52, "high").when(score >= 0.28, "medium").when(score >= 0.12, "low").otherwise("unresolved")
    )


def facility_score(match: Column, compliance: Column, enforcement: Column, emissions: Column, waste: Column, confirmed: Column) -> Column:
    """Points of a facility: its match and how many flags of each kind it has."""
    flags = F.size(compliance) * 6 + F.size(enforcement) * 10 + F.size(emissions) * 4 + F.size(waste) * 5
    return match * 40 + flags + F.when(_true(confirmed), 25).otherwise(0)


# fixed values: points of segment notes, by heading and body; subjects of other notes
SEGMENT_HEADINGS = [
    (r"\binformation\s+about\b.*\boperating\s+segments\b", 48), (r"\bsegment\s+information\b", 50), (r"\boperating\s+segments\b", 50), (r"\breportable\s+segments\b", 45),
    (r"\bsegment\s+reporting\b", 40), (r"\bsegment\s+and\s+geographic\b", 35), (r"\bdisaggregated\s+revenue\b", 30), (r"\brevenue\s+by\s+segment\b", 28),
    (r"\bgeographic\s+information\b", 25), (r"\bmajor\s+customers\b", 20),
]
SEGMENT_BODIES = [
    (r"\breportable\s+segment\b", 20), (r"\boperating\s+segment\b", 20), (r"\bdisaggregated\s+revenue\b", 15), (r"\bgeographic\s+revenue\b", 15), (r"\bsegment\s+revenue\b", 15),
    (r"\bsegment\s+profit\b", 15), (r"\bchief\s+operating\s+decision\s+maker\b", 15),
    (r"\bproduct\s+revenue|\bservice\s+revenue|\bcustomer\s+type|\bbusiness\s+unit|\boperating\s+division|\bgeograph", 10),
]
OTHER_NOTES = r"\b(debt|lease|income\s+tax|fair\s+value|stock\s+compensation|equity|earnings\s+per\s+share|pension|commitments?\s+and\s+contingencies)\b"


def segment_note(heading: Column, body: Column) -> Column:
    """Struct of heading, body and total points of a note that may be the segment note; other subjects get -100."""
    other = found(heading, OTHER_NOTES) & ~found(heading, r"\bsegment|disaggregat|revenue\s+by|operating\s+segment|reportable\b")
    head = additive([(found(heading, p), float(n)) for p, n in SEGMENT_HEADINGS])
    own = additive([(found(body, p), float(n)) for p, n in SEGMENT_BODIES])
    about_revenue = found(heading, r"\brevenue\s+recognition\b|^note\s+\d+.*\brevenue\b|\bnet\s+revenue\b")
    has_segments = found(body, r"\bsegment|reportable\s+segment|operating\s+segment|disaggregated\s+revenue|revenue\s+by\s+segment|geographic\s+revenue|product\s+revenue|service\s+revenue|business\s+unit\b")
    plain_revenue = found(heading, r"\brevenue\b") & ~found(heading, r"\bsegment|disaggregat|geographic\b")
    extra = F.when(about_revenue, F.when(has_segments, 25.0).otherwise(-15.0)).when(plain_revenue, F.when(found(body, r"\bsegment|disaggregat|geographic|product|service|customer\b"), 20.0).otherwise(-10.0)).otherwise(0.0)
    pick = lambda ours, theirs: F.when(other, float(theirs)).otherwise(ours)
    return F.struct(pick(head + extra, -100).alias("heading"), pick(own, 0).alias("body"), pick(head + extra + own, -100).alias("total"))


# fixed values: endings of company names in tables of subsidiaries
TABLE_SUFFIXES = r"\b(llc|l\.l\.c\.|inc\.?|corp\.?|limited|ltd\.?|plc|gmbh|s\.a\.|n\.v\.|\boy\b|\baps\b|\bs\.?\s*r\.?\s*l\.?\b)\b"


def subsidiary_table(rows: Column) -> Column:
    """Points of a table (array of rows of cells) that may be the list of subsidiaries."""
    text = F.lower(F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), "\n"))
    line = F.regexp_replace(F.array_join(F.flatten(rows), ""), r"\s+", "")
    brackets, shares = F.regexp_count(text, F.lit(r"\(")), F.regexp_count(text, F.lit(r"\(\s*\d{1,3}(?:\.\d+)?\s*%\)"))
    return additive(
        [
            (found(text, r"\blist\s+of\s+subsidiaries\b"), 400.0), (brackets >= 2, F.least(brackets * 14, F.lit(320)).cast("double")), (shares >= 2, F.least(shares * 22, F.lit(220)).cast("double")),
            (found(text, TABLE_SUFFIXES), 120.0), ((F.length(line) < 180) & found(line, r"\.htm(l)?$"), -900.0),
        ]
    )


def table_candidate(rows: Column) -> Column:
    """Size of a table and its points as a list of subsidiaries."""
    width = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    full = F.size(F.filter(F.flatten(rows), lambda c: F.length(F.trim(c)) > 1))
    return F.size(rows) * width * 8 + full + subsidiary_table(rows)


def footnote_confidence(n: dict[str, Column], flags: dict[str, Column]) -> Column:
    """High, Medium, Low or Not Found for the best candidate of a debt footnote.

    n: total, negative, body_terms, indicators, table_evidence, table_keywords, paths; flags: notes_found,
    clear_heading, wrong_heading (risk factors, exhibit index, market risk), anchored (found by its tables)."""
    table = (n["table_evidence"] >= 30) | (n["table_keywords"] >= 22)
    terms, signs, paths = n["body_terms"], n["indicators"], n["paths"]
    without_notes = F.when((n["total"] < 28) & (terms < 2) & ~table, "Not Found").otherwise("Low")
    negative = F.when((terms >= 5) | table | (signs >= 6), "Medium").otherwise("Low")
    high = (paths >= 2) & (flags["clear_heading"] | table) & ((signs >= 3) | (terms >= 3)) & (n["negative"] < 70)
    medium = (terms >= 5) | (signs >= 6) | table | (flags["anchored"] & ((signs >= 5) | (terms >= 4)))
    weak = ~flags["clear_heading"] & (signs < 4) & ~table & (terms < 5) & (paths < 2)
    return (
        F.when(~flags["notes_found"], without_notes).when(flags["wrong_heading"] & (paths < 2), "Low").when(n["negative"] >= 95, negative).when(high, "High")
        .when(medium, F.when(weak, "Low").otherwise("Medium")).when((terms >= 2) | (signs >= 3) | (n["total"] >= 42), "Low").otherwise("Not Found")
    )


def overlap_boost(body: Column, blocks: Column, most: int = 85) -> Column:
    """Points for tagged blocks (array of structs of text, in normal form, and disclosure) that a body holds: by their
    first 120 characters, if at least 44, or by their first 72; at most so many."""

    def points(b: Column) -> Column:
        start, half = F.substring(b["text"], 1, 120), F.substring(b["text"], 1, 72)
        whole = F.when(b["disclosure"], 34.0).otherwise(24.0)
        part = F.when(b["disclosure"], 18.0).otherwise(12.0)
        return F.when(F.length(start) < 44, 0.0).when(body.contains(start), whole).when(body.contains(half), part).otherwise(0.0)

    return F.least(F.lit(float(most)), F.aggregate(F.transform(blocks, points), F.lit(0.0), lambda a, x: a + x))


def folder_match(name: Column, ticker: str) -> Column:
    """Struct of score and kind: how well the name of a folder fits a ticker."""
    t = ticker.upper()
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    up, norm = F.upper(F.trim(name)), "".join(c for c in ticker.lower() if c.isascii() and c.isalnum())
    pair = lambda score, kind: F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"))
    # a blank after the ticker isn't asked for, so any name that starts with it counts
    prefix = up.startswith(t) | up.startswith(f"[{t}]")
    words = F.transform(F.split(F.trim(name), r"[\s._\-/,]+"), lambda w: bare(w))
    return (
        F.when(up == t, pair(100, "exact_case_insensitive")).when(prefix, pair(95, "ticker_prefix")).when(F.upper(F.element_at(F.split(F.trim(name), r"[\s._-]+"), 1)) == t, pair(90, "first_token"))
        .when(bare(name).contains(norm) & F.lit(len(norm) >= 2), pair(80, "normalized_contains")).when(F.array_contains(words, norm), pair(75, "token_match")).otherwise(pair(0, "weak"))
    )
