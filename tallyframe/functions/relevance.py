"""How well found items fit a company: points of conditions, each table of points in full and in its order.

ticker, company and aliases are the search's own; every other argument is a column. Ages are counted up to as_of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import periods
from tallyframe.functions import text as tx
from tallyframe.functions.classes import found
from tallyframe.functions.keep import js_round
from tallyframe.functions.rules import additive

# fixed values: (age under, points) in days; for posts in days too, from 6, 24 and 72 hours
NEWS_AGES = [(2, 22), (7, 16), (30, 10), (180, 4)]
REPORT_AGES = [(30, 18), (90, 12), (365, 6)]
POST_AGES = [(0.25, 14), (1, 10), (3, 6)]
# fixed values: words of finance in posts, of forum posts, of research pages
POST_FINANCE = r"(earnings|guidance|debt|bond|credit|downgrade|upgrade|refinanc|maturity|default|bankrupt|ebitda)"
FORUM_FINANCE = r"(debt|bond|bankrupt|chapter\s*11|restruct|distress|covenant|default|maturity|refinanc|credit|high\s*yield|leveraged|short\s+thesis|long\s+thesis|earnings|equity)"
RESEARCH = r"(research|report|analysis|note|insight|outlook|webinar|podcast|transcript|presentation|distress|restructur|covenant|credit|high\s+yield|leveraged|default|maturity|refinanc|bankrupt|chapter\s+11)"
# fixed values: forums with a high signal, words of jokes, sites' own pages, one provider's path
FORUMS = ["securityanalysis", "valueinvesting", "investing", "stocks", "finance"]
JOKES = r"(\bmeme\b|🚀|to the moon|diamond hands)"
OWN_PAGES, PROVIDER, PROVIDER_PATH = r"(login|signup|trial|careers|privacy|terms|about)", "wsj_bankruptcy", r"/pro/bankruptcy|/news/types/pro-bankruptcy-bankruptcy"


def _or(c: Column | None, other) -> Column:
    return F.lit(other) if c is None else F.coalesce(c, F.lit(other))


def _low(*parts: Column) -> Column:
    """The parts in lower case with a blank between them; nulls are empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _holds(text: Column, name: str, least: int) -> Column:
    return text.contains(name.strip().lower()) if len(name.strip()) >= least else F.lit(False)


def news_points(title: Column, summary: Column, tickers: Column, n_providers: Column, at: Column, ticker: str, company: str, as_of: Column, priority: Column | None = None, aliases: list[str] = (), image: Column | None = None, sentiment: Column | None = None) -> Column:
    """Relevance of an article. priority: the best provider's (null: 5); image and sentiment: null where there is none."""
    blob, first = _low(title, summary), (company.split() or [""])[0]
    none = F.lit(None).cast("string")
    return additive(
        [
            (F.array_contains(F.transform(tickers, F.upper), ticker.strip().upper()), 35.0), (_holds(blob, ticker, 1), 18.0), (_holds(blob, company, 3), 28.0), (_holds(blob, first, 3) & F.lit(len(company.strip()) >= 3), 10.0),
            *[(_holds(blob, a, 3), 12.0) for a in aliases], (F.lit(True), periods.age_points(at, as_of, NEWS_AGES)), (F.lit(True), F.least(F.lit(15), 7 * n_providers).cast("double")), (F.length(summary) > 80, 6.0),
            ((none if image is None else image).isNotNull(), 4.0), ((none if sentiment is None else sentiment).isNotNull(), 2.0), (F.lit(True), F.greatest(F.lit(0), 6 - F.least(F.lit(6), _or(priority, 5))).cast("double")),
            (F.length(tx.match_title(F.coalesce(title, F.lit("")))) < 12, -4.0),
        ]
    )


def report_points(title: Column, snippet: Column, url: Column, tickers: Column, signals: Column, kind: Column, at: Column, ticker: str, company: str, as_of: Column, confidence: Column, prior: Column) -> Column:
    """Relevance of a research report. signals: names of what supports it (broker_domain_match, url_hint:..., ...);
    kind: the report's class; confidence: 0 to 1; prior: a hundredth of it counts."""
    blob = _low(title, snippet)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/+$", "")
    counted = F.aggregate(F.transform(signals, lambda s: F.when(s == "broker_domain_match", 12.0).when(s.startswith("url_hint:"), 4.0).when(s == "company_name_in_text", 10.0).when(s == "ticker_in_text", 6.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return additive(
        [
            (F.array_contains(F.transform(tickers, F.upper), ticker.strip().upper()), 40.0), (_holds(blob, ticker, 1), 22.0), (_holds(blob, company, 3), 28.0), (F.lit(True), counted), (~kind.isin("unknown", "research_landing_page"), 14.0), (kind == "research_landing_page", -25.0), (kind == "research_portal", 4.0),
            (found(F.coalesce(path, F.lit("")), r"^(/(research|insights|ideas))?$"), -35.0), (F.lit(True), periods.age_points(at, as_of, REPORT_AGES)), (F.length(snippet) > 80, 8.0), (confidence > 0.5, 10.0), (F.length(tx.match_title(F.coalesce(title, F.lit("")))) < 14, -6.0), (F.lit(True), prior * 0.01),
        ]
    )


def engagement(likes: Column, reposts: Column, replies: Column, quotes: Column, views: Column) -> Column:
    """Weighted counts of a post; nulls are 0."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return n(likes) + 2 * n(reposts) + 1.5 * n(replies) + 2.5 * n(quotes) + 0.0005 * n(views)


def post_points(text: Column, cashtags: Column, at: Column, ticker: str, company: str, as_of: Column, is_reply: Column, is_repost: Column, engaged: Column, ambiguous: bool = False) -> Column:
    """Relevance of a short post; engaged as engagement() gives it."""
    blob = _low(text)
    tagged, named = blob.contains("$" + ticker.strip().lower()), _holds(blob, company, 1)
    return additive(
        [
            (F.array_contains(F.transform(cashtags, F.upper), ticker.strip().upper()), 55.0), (tagged, 35.0), (_holds(blob, ticker, 1), 10.0), (_holds(blob, company, 3), 22.0), (found(text, POST_FINANCE), 10.0), (F.lit(True), periods.age_points(at, as_of, POST_AGES)),
            (is_reply, -6.0), (is_repost, -12.0), (F.lit(ambiguous) & ~tagged & ~named, -18.0), (F.lit(True), F.least(F.lit(18.0), engaged * 0.15)),
        ]
    )


def forum_points(title: Column, body: Column, forum: Column, score: Column, comments: Column, n_queries: Column, ticker: str, company: str, aliases: list[str] = (), ambiguous: bool = False) -> Column:
    """Struct of score (to 0.1) and bucket (high from 72, medium from 48, by the exact score) of a forum post."""
    t = _low(title)
    b = F.concat(t, F.lit("\n"), _low(body))
    named, in_title = _holds(b, company, 3), _holds(t, company, 3)
    alias = F.lit(False)
    for a in aliases:
        alias = alias | _holds(t, a, 3)
    logged = lambda c, times, most: F.least(F.lit(most), F.log1p(F.greatest(F.coalesce(c, F.lit(0)).cast("double"), F.lit(0.0))) * times)
    total = additive(
        [
            (_holds(t, ticker, 1), 38.0), (~_holds(t, ticker, 1) & _holds(b, ticker, 1), 16.0), (in_title, 34.0), (~in_title & named, 20.0), (alias, 14.0), (found(b, FORUM_FINANCE), 12.0), (F.lower(forum).isin(*FORUMS), 12.0), (F.lit(True), logged(score, 4, 22.0)), (F.lit(True), logged(comments, 3, 18.0)),
            (n_queries >= 2, 10.0), (F.lit(ambiguous) & ~named, -20.0), (found(title, JOKES), -8.0),
        ]
    )
    return F.struct((F.floor(total * 10 + 0.5) / 10).alias("score"), F.when(total >= 72, "high").when(total >= 48, "medium").otherwise("low").alias("bucket"))


def page_points(title: Column, snippet: Column, excerpt: Column, url: Column, provider: Column, page_kind: Column, access: Column, important: Column, ticker: str, company: str, aliases: list[str] = (), ambiguous: bool = False) -> Column:
    """Struct of score and bucket (high from 70, medium from 45) of a found page. important: its path is one of the
    provider's important ones; access: public, partially_gated or gated."""
    t = _low(title)
    b = F.concat(t, F.lit("\n"), _low(snippet), F.lit("\n"), _low(excerpt))
    in_title, named = _holds(t, company, 3), _holds(b, company, 3)
    alias = F.lit(False)
    for a in aliases:
        alias = alias | _holds(t, a, 3)
    total = additive(
        [
            (_holds(t, ticker, 1), 35.0), (~_holds(t, ticker, 1) & _holds(b, ticker, 1), 16.0), (in_title, 32.0), (~in_title & named, 18.0), (alias, 18.0), (found(title, RESEARCH) | found(snippet, RESEARCH) | found(excerpt, RESEARCH), 14.0), (important, 16.0), ((provider == PROVIDER) & found(url, PROVIDER_PATH), 18.0),
            (page_kind == "generic_page", -18.0), (found(url, OWN_PAGES), -30.0), (access == "gated", -6.0), (access == "partially_gated", -2.0), (F.lit(ambiguous) & ~named, -14.0),
        ]
    )
    return F.struct(total.alias("score"), F.when(total >= 70, "high").when(total >= 45, "medium").otherwise("low").alias("bucket"))


# fixed values: points of an entity's role in credit documents
ROLES = {
    "borrower": 40, "issuer": 40, "co_issuer": 40, "guarantor": 35, "grantor": 30, "pledgor": 30, "collateral_owner": 30, "restricted_subsidiary": 20, "unrestricted_subsidiary": 25, "excluded_subsidiary": 15, "receivables_subsidiary": 30, "securitization_subsidiary": 30,
}
# fixed values: points of evidence on an entity
ENTITY_EVIDENCE = {
    "listed": 20, "ucc_debtor": 25, "material_collateral": 15, "collateral_kinds": 10, "name_root": 10, "finance_pattern": 15, "asset_pattern": 15, "hq_address": 20, "facility_address": 15, "same_city": 2,
}


def entity_points(role: Column, evidence: dict[str, Column], generic_agent: Column, name_only: Column, far_away: Column, other_industry: Column) -> Column:
    """Relevance of an entity, 0 to 100: points of its role and of evidence (flags by the names of ENTITY_EVIDENCE); at
    most 10 on a generic agent alone, at most 25 on its name alone unless listed; less for geography and industry."""
    total = F.lit(0)
    for name, points in ROLES.items():
        total = F.when(role == name, points).otherwise(total)
    for name, points in ENTITY_EVIDENCE.items():
        total = total + F.when(_or(evidence.get(name), False), points).otherwise(0)
    listed = _or(evidence.get("listed"), False)
    total = F.when(_or(generic_agent, False), F.least(total, F.lit(10))).otherwise(total)
    total = F.when(_or(name_only, False) & ~listed, F.least(total, F.lit(25))).otherwise(total)
    total = total - F.when(_or(far_away, False), 10).otherwise(0) - F.when(_or(other_industry, False), 15).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


# fixed values: weights of the parts of the overall risk, and of missing confidence
RISKS = {"disclosure": 0.2, "compliance": 0.18, "enforcement": 0.17, "emissions": 0.12, "waste": 0.13, "permits": 0.1}
MISSING = 0.1


def overall_risk(parts: dict[str, Column], confidence: Column) -> Column:
    total = F.lit(0.0)
    for name, weight in RISKS.items():
        total = total + parts[name] * weight
    return js_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total + (100 - confidence) * MISSING)))
