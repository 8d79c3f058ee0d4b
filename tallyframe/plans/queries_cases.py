"""Queries that hold rule tables and scores to cases: each row of the part table meets one case by its key, the operator
gives its answer and the SQL the expected one. Each table has a case for each rule and branch that decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import classes, scores
from tallyframe.functions import text as tx
from tallyframe.plans.queries import ORACLE, QUERIES, table

Case = tuple[tuple, str | float | int | None]


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


#: The cases of each query: inputs, answers, operator.
CASES: dict[str, tuple[list[Case], Callable[..., Column]]] = {}
#: How whole documents get into an input of a query: its number, and where the document's text or path stands.
EMBEDDED: dict[str, tuple[int, str]] = {
    "fn_c01_report_types": (0, "after"), "fn_c01_report_access": (0, "folder"), "fn_c02_rating_results": (0, "after"), "fn_c02_agencies": (0, "after"), "fn_c02_rating_access": (0, "after"), "fn_c02_instrument_hints": (0, "after"),
    "fn_c03_document_class": (0, "after"), "fn_c04_instrument_types": (0, "after"), "fn_c05_source_files": (0, "folder"), "fn_c06_material_tiers": (0, "folder"), "fn_c07_topics": (0, "after"), "fn_c10_exhibits": (0, "after"),
    "fn_c10_items": (0, "after"), "fn_c10_schedule_roles": (0, "after"), "fn_c11_page_types": (1, "parameter"), "fn_c11_page_access": (1, "parameter"), "fn_c12_outlets": (0, "parameter"), "fn_c15_exhibit_21": (0, "after"),
    "fn_c15_schedules": (0, "folder"), "flt_08_debt_exhibits": (0, "folder"), "flt_09_debt_phrases": (0, "folder"), "flt_21_exhibit_names": (0, "folder"), "fn_r03_ratings_match": (0, "folder"), "fn_r03_url_and_age": (0, "parameter"),
    "fn_r14_segment_notes": (0, "after"), "fn_r15_subsidiary_tables": (0, "folder"), "fn_r18_overlap": (0, "after"), "topk_16_exhibit_files": (0, "folder"), "flt_17_paths": (0, "folder"), "fn_s30_links": (0, "after"),
    "fn_s17_numbers_and_dates": (0, "folder"), "fn_s11_generic_agents": (0, "after"), "fn_s23_states": (0, "before"), "fn_j02_states": (0, "after"), "fn_s20_company_names": (0, "folder"), "flt_19_contents_tables": (0, "folder"),
}


def embedded(case: Column, how: str, mask: str | None = None) -> Column:
    """A case's text with a document around it: its whole text after it or before it, or its source and language as
    folders before it or as a query after it."""
    text, path = F.coalesce("text", F.lit("")), F.concat_ws("/", "source", "lang")
    text = F.regexp_replace(text, mask, "_") if mask else text
    return {
        "after": F.concat(case, F.lit(" "), text),
        "before": F.concat(text, F.lit(" "), case),
        "folder": F.concat(path, F.lit("/"), case),
        "parameter": F.concat(case, F.lit("?at="), path),
    }[how]


#: What decides in a query where documents themselves may hold it (in a key or a run of letters): it stands as _ in them, so
#: that the case decides. A _ belongs to no rule and is no border of a word.
MASKED: dict[str, str] = {"fn_c07_topics": "(?i)" + "|".join(p for _, conditions in classes.TOPICS for _, p in conditions)}


def cases(name: str, rows: list[Case], operator: Callable[..., Column]) -> None:
    """Registers a query of the operator over the cases (inputs, expected), each document or part one of them. Where
    EMBEDDED names the query, the document's text stands in one of the inputs."""
    CASES[name] = (rows, operator)
    kind = next((type(e) for _, e in rows if e is not None), str)
    sql_type = {str: "VARCHAR", float: "DOUBLE", int: "INT", bool: "BOOLEAN"}[kind]
    index, how = EMBEDDED.get(name, (-1, ""))
    source, key = ("documents", "doc_id") if how else ("part", "p_partkey")
    ORACLE[name] = f"SELECT {key}, ([{', '.join(_sql(e) for _, e in rows)}]::{sql_type}[])[{key} % {len(rows)} + 1] AS answer FROM {source}"

    def run(spark, sf_dir):
        at = (F.col(key) % len(rows) + 1).cast("int")
        inputs = [F.element_at(F.array(*[F.lit(case[i]) for case, _ in rows]), at) for i in range(len(rows[0][0]))]
        if how:
            inputs[index] = embedded(inputs[index], how, MASKED.get(name))
        return table(spark, sf_dir, source).select(key, operator(*inputs).alias("answer"))

    run.__name__ = name
    QUERIES[name] = run


cases(
    "fn_c01_report_types",
    [
        (("Research Portal", "", "https://a.com"), "research_portal"), (("x", "please sign in to view", "https://a.com"), "research_portal"), (("x", "", "https://a.com/signin?x"), "research_portal"),
        (("A Thematic view", "", "https://a.com"), "thematic_note"), (("thematic sector view", "", "https://a.com"), "sector_note"), (("Group note on steel", "", "https://a.com"), "sector_note"),
        (("We initiate at buy", "", "https://a.com"), "initiation"), (("Cuts to hold", "", "https://a.com"), "downgrade"), (("Lowers PT", "", "https://a.com"), "downgrade"),
        (("Lifts PT", "", "https://a.com"), "upgrade"), (("raises target", "", "https://a.com"), "upgrade"), (("Reiterates buy", "", "https://a.com"), "rating_change"), (("Two notches", "", "https://a.com"), "rating_change"),
        (("PT of 20", "", "https://a.com"), "target_price_change"), (("Previewing Q3", "", "https://a.com"), "earnings_preview"), (("Results review", "", "https://a.com"), "earnings_recap"),
        (("Stock update", "", "https://a.com"), "company_update"), (("Our views", "", "https://a.com"), "public_insight"), (("Home", "", "https://a.com/research/"), "research_landing_page"),
        (("research  home", "", "https://a.com"), "research_landing_page"), (("nothing", "", "https://a.com/b"), "unknown"),
    ],
    classes.report_type,
)
cases(
    "fn_c01_report_access",
    [
        (("For subscribers", "", "https://a.com"), "subscription_likely"), (("Please login", "", "https://a.com"), "login_required"), (("login for free", "", "https://a.com/b"), "unknown"),
        (("x", "", "https://a.com/portal/x"), "login_required"), (("an open access piece", "", "https://a.com"), "public"), (("Newsroom", "", "https://a.com"), "public"), (("x", "", "https://a.com"), "unknown"),
    ],
    classes.report_access,
)
cases(
    "fn_c02_rating_results",
    [
        (("Fitch affirms X", "", "https://a.com"), "rating_action"), (("Issuer page", "", "https://a.com"), "issuer_rating"), (("issuer of bonds", "", "https://a.com"), "issue_rating"), (("A podcast", "", "https://a.com"), "commentary"),
        (("A podcast and report", "", "https://a.com"), "research"), (("x", "", "https://a.com/myresearchx"), "research"), (("x", "", "https://a.com/y"), "unknown"),
    ],
    classes.rating_result,
)
cases(
    "fn_c02_agencies",
    [
        (("https://www.fitchratings.com/x",), "Fitch"), (("https://ratings.moodys.com/x",), "Moody's"), (("https://disclosure.spglobal.com/x",), "S&P"), (("https://notmoodys.com/x",), None), (("nothing",), None),
    ],
    classes.agency_of,
)
cases(
    "fn_c02_rating_access",
    [
        (("https://a.com/login", "Fitch"), "login_required"), (("https://x.com/ResearchArticle/1", "S&P"), "subscription_likely"), (("https://ratings.moodys.com/1", "Moody's"), "subscription_likely"),
        (("https://www.fitchratings.com/research/1", "Fitch"), "subscription_likely"), (("https://www.fitchratings.com/research/1", "S&P"), "unknown"),
    ],
    classes.rating_access,
)
cases(
    "fn_c02_instrument_hints",
    [(("ABS and clo", ""), "ABS,CLO"), (("Term loan", "TLB revolver"), "Term loan,Revolving"), (("senior unsecured", "secured bond, Subordinated cdo"), "CDO,Senior unsecured,Secured,Subordinated"), (("tlb", ""), "")],
    lambda a, b: F.array_join(classes.instrument_hints(a, b), ","),
)
cases(
    "fn_c03_document_class",
    [
        (("dex-21.htm", "x", "10-K"), "exhibit_21"), (("a.htm", "Subsidiaries of the  Registrant", "10-K"), "exhibit_21"), (("ex22.htm", "Guarantor list", "10-K"), "exhibit_22"), (("ex22.htm", "none", "10-K"), "periodic_filing"),
        (("a.htm", "Senior Notes due", "S-3"), "prospectus"), (("prospectus.htm", "an Indenture", "X"), "prospectus"), (("prospectus.htm", "a credit agreement", "X"), "credit_agreement"), (("a.htm", "Senior notes", "8-K"), "indenture"),
        (("a.htm", "revolving line of credit", "8-K"), "credit_agreement"), (("a.htm", "Pledge  agreement", "8-K"), "security_or_guarantee"), (("a.htm", "x", " 20-f "), "periodic_filing"), (("a.htm", "x", "8-K"), "other"),
    ],
    classes.debt_document,
)
cases(
    "fn_c04_instrument_types",
    [
        (("Asset-Based revolving credit",), "ABL"), (("a Revolver",), "revolving credit facility"), (("Term B loans",), "term loan"), (("7% senior secured notes",), "senior secured notes"), (("senior unsecured note",), "senior unsecured notes"),
        (("subordinated notes",), "subordinated notes"), (("convertible notes",), "convertible notes"), (("receivables purchase facility",), "receivables facility"), (("special purpose vehicle",), "securitization"),
        (("this credit agreement",), "term loan/revolver (credit agreement)"), (("this indenture",), "senior notes (indenture)"), (("lease",), "other"),
    ],
    classes.instrument_type,
)
cases(
    "fn_c05_source_files",
    [
        (("x/Credit Agreement.pdf",), "debt_document"), (("cred facility.pdf",), "debt_document"), (("a/10-K 2020.htm",), "sec_filing"), (("Q3 earnings call.txt",), "transcript"), (("Investor day.pdf",), "presentation"), (("Moody.pdf",), "rating_agency"),
        (("org  chart.pdf",), "org_legal"), (("news release.pdf",), "press_release"), (("wsj.txt",), "news"), (("lbo.xlsx",), "model_spreadsheet"), (("memo.txt",), "notes"), (("zzz.bin",), "other"), (("loan/zzz.bin",), "debt_document"),
    ],
    classes.source_file,
)
cases(
    "fn_c06_material_tiers",
    [
        (("a/dex101.htm", False, "x"), 2), (("Exhibit 10.1.htm", False, "x"), 2), (("Earnings webcast.txt", False, "x"), 2), (("slide deck.pdf", False, "x"), 2), (("loan.pdf", True, "x"), 2), (("photo.png", False, "x"), 3), (("10-k.htm", False, "[Binary file]"), 4), (("", False, "x"), 3),
    ],
    classes.material_tier,
)
cases(
    "fn_c07_topics",
    [
        (("a Superfund site",), "superfund_cercla"), (("hazardous waste",), "rcra_hazwaste"), (("PFAS in water",), "pfas"), (("some Asbestos here",), "asbestos"), (("groundwater",), "environmental_liability"), (("an aro",), "aro"),
        (("cleanup reserve",), "remediation_reserve"), (("clean air act",), "permitting"), (("effluent",), "water_waste"), (("transition risk",), "emissions_climate"), (("environmental capex",), "capex_environmental"),
        (("oil spill at the landfill",), "spill_release"), (("environmental litigation",), "legal_environmental"), (("landfill",), "water_waste"), (("mine reclamation",), "water_waste"), (("nothing",), "other"),
    ],
    classes.topic,
)
cases(
    "fn_c10_exhibits",
    [
        (("Debtor-in-possession loan", ""), "Other Debt-Related Document"), (("DIP credit", ""), "DIP Credit Agreement"), (("Exit financing", ""), "Exit Facility"), (("RSA", ""), "Restructuring Support Agreement"), (("Exchange offer", ""), "Exchange Agreement"),
        (("Supplemental indenture", ""), "Supplemental Indenture"), (("Indenture", ""), "Indenture"), (("Indenture purchase", "global note"), "Notes / Form of Notes"), (("Intercreditor", ""), "Intercreditor Agreement"), (("Pledge agreement", ""), "Security Agreement"),
        (("Collateral trust", ""), "Collateral Trust Agreement"), (("Collateral agreement", ""), "Collateral Agreement"), (("Guaranty", ""), "Guarantee Agreement"), (("Amended and Restated big credit", ""), "Credit Agreement"), (("Facility agreement", ""), "Credit Agreement"),
        (("Amendment to loan", ""), "Credit Agreement Amendment"), (("Waiver by lender", ""), "Waiver / Consent"), (("Term loan", ""), "Credit Agreement"), (("x", "y"), "Other Debt-Related Document"),
    ],
    classes.exhibit_class,
)
cases("fn_c10_items", [(("Item 2.03 and item 9.01, Item 2.03",), "Item 2.03,Item 9.01"), (("none",), "")], lambda x: F.array_join(classes.filing_items(x), ","))
cases("fn_c10_schedule_roles", [(("Subsidiary Guarantors",), "guarantor"), (("Borrowers",), "borrower"), (("Grantors",), "grantor"), (("Pledgors",), "pledgor"), (("Unrestricted subsidiaries",), "restricted_subsidiary"), (("Loan parties",), "loan_party"), (("Fees",), None)], classes.schedule_role)
cases(
    "fn_c11_page_types",
    [
        (("a", "https://a.com/x", True, "t"), "generic_page"), (("wsj_bankruptcy", "https://a.com/x", True, "t"), "gated_article"), (("a", "https://a.com/podcast/1", False, "t"), "podcast"), (("a", "https://a.com/events/1", False, "an event"), "event"),
        (("a", "https://a.com/events/1", False, "talk"), "webinar"), (("a", "https://a.com/x", False, "Transcript"), "transcript"), (("a", "https://a.com/x.pdf?y", False, "t"), "presentation"), (("a", "https://a.com/x", False, "Outlook"), "research_report"),
        (("a", "https://a.com/x", False, "press room"), "news"), (("a", "https://a.com/news/1", False, "t"), "article"), (("wsj_bankruptcy", "https://a.com/x", False, "t"), "article"), (("a", "https://a.com/careers", False, "t"), "irrelevant"),
    ],
    classes.page_type,
)
cases(
    "fn_c11_page_access",
    [
        (("a", "https://a.com", 403, ""), "gated"), (("a", "https://a.com", 402, ""), "gated"), (("wsj_bankruptcy", "https://wsj.com", 200, "Sign in"), "gated"), (("a", "https://a.com", 200, "subscribe: paywall"), "partially_gated"), (("a", "https://a.com", 200, "subscribe"), "public"),
    ],
    classes.page_access,
)
cases(
    "fn_c12_outlets",
    [
        (("https://www.sec.gov/x",), "SEC:SEC"), (("https://wsj.com/x",), "Wall Street Journal:WSJ"), (("https://www.bloomberg.com",), "Bloomberg:Bloomberg"), (("https://FT.com",), "Financial Times:FT"), (("https://businesswire.com",), "Business Wire:press"),
        (("https://prnewswire.com",), "PR Newswire:press"), (("https://globenewswire.com",), "GlobeNewswire:press"), (("https://accesswire.com",), "ACCESSWIRE:press"), (("https://newsfilecorp.com",), "Newsfile:press"), (("https://news.google.com",), "Google News:other"),
        (("https://a.com",), "Web:trade"),
    ],
    lambda u: F.concat_ws(":", classes.outlet(u)["name"], classes.outlet(u)["kind"]),
)
cases("fn_c13_ambiguous_tickers", [(("ge",), True), ((" It ",), True), (("AAPL",), False), (("WEE",), False)], classes.ambiguous_ticker)
cases(
    "fn_c15_exhibit_21",
    [
        (("see EX-21.1",), True), (("EX–21 list",), True), (("see EX21",), True), (("EX.21",), True), (("Exhibit No. 21",), True), (("exhibit  21",), True), (("(filed as EX_21)",), True), (("EX-210",), False), (("x",), False), (("none here",), False),
    ],
    classes.marked_exhibit_21,
)
_pad = " " * 0 + "word " * 80
cases(
    "fn_c15_schedules",
    [
        ((_pad + "List of subsidiaries: A Inc.",), True), ((_pad + "A LLC, B Corp.",), False), ((_pad + "A LLC " * 10,), True), ((_pad + "Summary compensation table " + "A LLC " * 5,), False), (("List of subsidiaries: A Inc.",), False), ((_pad + "list of subsidiaries",), False),
    ],
    classes.subsidiary_schedule,
)
cases(
    "flt_04_periods",
    [(("FY", "10-K"), "a"), (("FY", "10-Q"), None), (("Q2", "10-Q"), "q"), (("Q4", "10-K"), "q"), (("Q4", "20-F"), None), (("FY", "40-F"), "a")],
    lambda fp, form: F.when(classes.annual_period(fp, form), "a").when(classes.quarter_period(fp, form), "q"),
)
cases(
    "flt_08_debt_exhibits",
    [
        (("ex-4.htm", "", False), True), (("ex-10.htm", "", False), False), (("ex-10.htm", "", True), True), (("ex-10.htm", "Term Loan", False), True), (("ex-99.htm", "press", False), False), (("ex-99.htm", "an Indenture", False), True), (("ex-25.htm", "trustee", False), False), (("x.htm", "Lock–up agreement", False), True),
    ],
    classes.debt_exhibit,
)
cases(
    "flt_09_debt_phrases",
    [
        (("An Amended and Restated Credit Agreement",), True), (("asset–based loan",), True), (("Form  of   Note",), True), (("Deed of trust!",), True), (("pari passu intercreditor",), True), (("Joinder",), True), (("Backstop agreement",), True), (("lease of a building",), False), ((None,), False),
    ],
    classes.has_debt_phrase,
)
cases(
    "flt_21_exhibit_names",
    [
        (("a/ex-4.1.htm",), True), (("ex4.htm",), True), (("ex-45.htm",), False), (("ex-10.15x.htm",), True), (("ex-21.htm",), True), (("ex-21.1.htm",), False), (("ex-25a.htm",), True), (("dex4.htm",), False),
    ],
    classes.priority_exhibit,
)
cases(
    "flt_21_wanted_exhibits",
    [
        (("main.htm", "main.htm", True), False), (("index-1.htm", "main.htm", True), False), (("ex-21.htm", "main.htm", False), False), (("ex-22.htm", "main.htm", False), True), (("ex-10.htm", "main.htm", False), True), (("other.htm", "main.htm", True), True), (("other.htm", "main.htm", False), False),
    ],
    lambda f, p, k: classes.wanted_exhibit(f, p, k, False, True),
)
cases(
    "fn_r03_ratings_match",
    [
        (("ACME Steel outlook", "", "https://x.com"), 50.0), (("ASC on Acme Steel", "", "https://x.com"), 78.0), (("Acme only", "", "https://x.com"), 37.0), (("nothing", "", "https://x.com"), 25.0), (("ASC: Acme Steel, the Anvil maker", "", "https://x.com"), 86.0), (("anvil", "", "https://x.com/asc"), 61.0),
    ],
    lambda t, s, u: scores.ratings_match(t, s, u, "ASC", "Acme Steel", ["ASC", "an", "Anvil"]),
)
cases(
    "fn_r03_url_and_age",
    [
        (("https://a.com/0123456789", 10), 16.0), (("https://a.com/0123", 400), 6.0), (("https://a.com/" + "x" * 120, 2000), -1.0), (("https://a.com/0123456789?" + "q" * 50, 5000), 2.0), (("no url", None), 0.0),
    ],
    lambda u, d: scores.ratings_url(u) + scores.freshness(d, scores.RATINGS_AGES),
)
cases(
    "fn_r06_newsletters",
    [((0.5, True, True, True, 0.5, 3, 7.0), 50 + 34 + 13 + 10 + 7.0), ((0.111, False, True, False, None, 30, 0.0), 11 + 10 + 0 + 6.0), ((0.9, False, False, True, 1.0, 400, 0.0), 90 + 6 + 25.0), ((0.9, None, False, None, 0.0, None, 1.5), 91.5)],
    lambda c, m, f, y, p, d, r: scores.newsletter_score(c, m, f, y, p, d, r),
)
_evidence = ("exact_root", "weak_name", "headquarters", "city_state", "officer", "credit_agreement", "finance_pattern", "unrelated_industry", "generic_agent_only", "similar_name_only", "no_official_link")
cases(
    "fn_r10_affiliates",
    [
        ((True, True, True, True, True, True, True, False, False, False, False), 100.0), ((True, False, False, True, False, False, False, False, False, False, False), 28.0), ((True, False, True, False, False, False, False, True, False, False, False), 35.0),
        ((True, False, True, False, True, False, False, False, True, False, False), 10.0), ((True, False, True, False, False, False, False, False, False, True, False), 25.0), ((True, False, True, False, False, False, False, False, False, False, True), 44.0),
        ((True, False, False, False, False, False, True, False, False, False, True), 35.0), ((False, False, False, False, False, False, False, True, False, False, False), 0.0), ((False, True, False, False, None, False, False, False, False, False, False), 5.0),
    ],
    lambda *c: scores.affiliate_score(dict(zip(_evidence, c))),
)
cases(
    "fn_r11_coverage",
    [((10, 5, 3, True, True), "high"), ((10, 5, 4, True, True), "medium"), ((10, 5, 3, False, True), "medium"), ((10, 2, 0, True, True), "low"), ((0, 5, 0, True, True), "low"), ((4, 1, 0, False, False), "low")],
    scores.coverage_quality,
)
cases(
    "fn_r12_match_confidence",
    [((0.52, "none"), "high"), ((0.28, "none"), "medium"), ((0.12, "none"), "low"), ((0.1, "none"), "unresolved"), ((0.0, "confirmed"), "high"), ((0.9, "rejected"), "unresolved")],
    scores.match_confidence,
)
cases(
    "fn_r12_facility_score",
    [((0.5, 2, 1, 0, 3, True), 20 + 12 + 10 + 0 + 15 + 25.0), ((1.0, 0, 0, 2, 0, False), 48.0), ((0.0, 0, 0, 0, 0, None), 0.0)],
    lambda m, a, b, c, d, ok: scores.facility_score(m, *[F.array_repeat(F.lit("f"), n) for n in (a, b, c, d)], ok),
)
cases(
    "fn_r14_segment_notes",
    [
        (("Debt", "operating segment"), -100.0), (("Equity by reportable segments", "x"), 45.0), (("Segment information", "reportable segment; geographic"), 80.0), (("Information about our operating segments", ""), 98.0), (("Revenue recognition", "business unit"), 35.0),
        (("Revenue recognition", "plain"), -15.0), (("Other revenue", "customer"), 20.0), (("Other revenue", "plain"), -10.0), (("Major customers", ""), 20.0),
    ],
    lambda h, b: scores.segment_note(h, b)["total"],
)
cases(
    "fn_r15_subsidiary_tables",
    [
        (("List of subsidiaries|A Inc.",), 520.0), (("A (50%)|B (49.5 %)",), 2 * 14 + 2 * 22.0), (("x.htm",), -900.0), (("plain|cells",), 0.0),
    ],
    lambda t: scores.subsidiary_table(F.transform(F.split(t, r"\|"), lambda x: F.array(x))),
)
cases(
    "fn_r17_folders",
    [(("acme",), "100 exact_case_insensitive"), (("ACME - x",), "95 ticker_prefix"), (("Acmeco",), "95 ticker_prefix"), (("The_acme",), "80 normalized_contains"), (("a-c-m-e",), "80 normalized_contains"), (("other",), "0 weak")],
    lambda n: F.concat_ws(" ", scores.folder_match(n, "acme")["score"].cast("string"), scores.folder_match(n, "acme")["kind"]),
)
_tagged = "the company has term loans and notes outstanding of the amounts below, and more of them in the table"
cases(
    "fn_r18_overlap",
    [((f"x {_tagged} y", True), 68.0), ((f"x {_tagged} y", False), 48.0), ((f"x {_tagged[:80]}", True), 36.0), ((f"x {_tagged[:80]}", False), 24.0), (("nothing", True), 0.0)],
    lambda body, d: scores.overlap_boost(body, F.array(*[F.struct(F.lit(_tagged).alias("text"), d.alias("disclosure"))] * 2)),
)
_numbers = ("total", "negative", "body_terms", "indicators", "table_evidence", "table_keywords", "paths")
_flags = ("notes_found", "clear_heading", "wrong_heading", "anchored")
cases(
    "fn_c14_footnotes",
    [
        ((20, 0, 1, 0, 0, 0, 0, False, False, False, False), "Not Found"), ((30, 0, 1, 0, 0, 0, 0, False, False, False, False), "Low"), ((90, 0, 9, 9, 30, 0, 1, True, True, True, False), "Low"), ((90, 95, 5, 0, 0, 0, 2, True, True, False, False), "Medium"),
        ((90, 95, 1, 0, 0, 0, 2, True, True, False, False), "Low"), ((90, 0, 3, 0, 0, 0, 2, True, True, False, False), "High"), ((90, 70, 5, 0, 0, 0, 2, True, True, False, False), "Medium"), ((50, 0, 4, 1, 0, 0, 1, True, False, False, True), "Low"),
        ((50, 0, 4, 5, 0, 0, 1, True, False, False, True), "Medium"), ((50, 0, 0, 0, 0, 22, 1, True, False, False, False), "Medium"), ((42, 0, 0, 0, 0, 0, 1, True, False, False, False), "Low"), ((41, 0, 1, 2, 0, 0, 1, True, False, False, False), "Not Found"),
    ],
    lambda *c: scores.footnote_confidence(dict(zip(_numbers, c)), dict(zip(_flags, c[len(_numbers) :]))),
)
cases(
    "fn_s05_titles",
    [(("  A  Title: of (Things)!",), "a title of things"), (("It's x-ray",), "it's x-ray"), (("",), "")],
    tx.match_title,
)
