"""Text functions as column expressions. Patterns are kept to ASCII classes so that other engines read them alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyframe.functions.keep import distinct_in_order

# fixed values: query parameters that only track visitors
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "gclid", "fbclid")
# fixed values: trailing words of company names
SUFFIXES = r"(INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|L ?L ?C|LLC|L ?P|LP|LTD|LIMITED|PLC|HOLDINGS|HOLDING|GROUP)"
# fixed values: irregular plurals of statement labels
PLURALS = {"liabilities": "liability", "activities": "activity", "securities": "security", "subsidiaries": "subsidiary", "categories": "category", "inventories": "inventory", "taxes": "tax", "losses": "loss"}
# fixed values: words that are no tags
STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "as", "by", "with", "from", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "not",
    "this", "that", "these", "those", "it", "its", "we", "our", "they", "their", "than", "then",
)
# fixed values: words that don't count when chunks are ranked
RANK_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "hers", "him", "his", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of",
    "on", "or", "our", "ours", "she", "so", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too", "us", "was", "we", "were", "what", "when",
    "where", "which", "who", "why", "will", "with", "you", "your",
)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def first_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first value of each key, in the order of the array; by one sort, so long arrays cost little more than they
    are long."""
    tagged = F.sort_array(F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    fresh = lambda t: F.filter(t, lambda x, j: (j == 0) | ~F.get(t, F.greatest(j - 1, F.lit(0)))["k"].eqNullSafe(x["k"]))
    kept = once(tagged, lambda t: F.sort_array(F.transform(fresh(t), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))))
    return F.transform(kept, lambda x: x["v"])


def chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def local_name(concept: Column) -> Column:
    """The local part of a qualified name: after the last slash of a URL, else after the last colon, else slash."""
    last = lambda sep: F.element_at(F.split(concept, sep), -1)
    return F.when(concept.contains("://"), last("/")).when(concept.contains(":"), last(":")).when(concept.contains("/"), last("/")).otherwise(concept)


def statement_label(label: Column) -> Column:
    """A statement label in the form in which labels are matched: lower case, without brackets, filler and plurals."""
    s = chain(F.lower(F.trim(label)), [(r"\([^)]*\)", ""), ("&", " and ")])
    s = chain(
        s,
        [
            (r"^(aggregate\s+)?amount\s+of\s+", ""),
            (r",?\s*net\s+of\s+(income\s+)?tax(es)?\s*,?", " "),
            (r"before\s+(addition|deduction)\s+(of|for)\s+(income\s+(from\s+)?)?", "before "),
            (r"after\s+(addition|deduction)\s+(of|for)\s+(income\s+(from\s+)?)?", "after "),
            (r",?\s*including\s+(accretion|amortization)\b[^,]*,?", " "),
        ],
    )
    s = chain(s, [(rf"\b{many}\b", one) for many, one in PLURALS.items()])
    s = chain(s, [(r"\b(\w{2,})ies\b", "$1y"), (r"\b(\w{3,}[^sui])s\b", "$1"), (r"^total\s+", ""), (r"[,;:]+\s*$", ""), (r"[^\w\s]", " ")])
    return one_space(s)


def match_title(title: Column) -> Column:
    return one_space(F.regexp_replace(F.lower(title), r"[^a-z0-9\s'-]", " "))


def word_set(title: Column, longer_than: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(match_title(title), " "), lambda w: F.length(w) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (arrays); 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common members over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigrams of two texts, counted with repeats."""
    x, y = bigrams(a), bigrams(b)
    count = lambda array, g: F.size(F.filter(array, lambda z: z == g))
    common = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, g: acc + F.least(count(x, g), count(y, g)))
    short = F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.35).otherwise(0.0)
    return F.when((F.length(a) < 2) | (F.length(b) < 2), short).otherwise(2 * common / (F.size(x) + F.size(y)))


def match_url(url: Column) -> Column:
    """A URL in the form in which URLs are matched: host in lower case, no fragment, tracking parameters or trailing
    slashes; null if it isn't one."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(*TRACKING)), "&")
    whole = F.concat(scheme, F.lit("://"), F.lower(rest), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(rest != "", whole)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^/?#:]+)", 1))


def host_allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or a subdomain of one."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith(f".{d}")
    return out


def url_quality(url: Column) -> Column:
    """2 for a secure scheme, 1 for a path of 6 to 119 characters, less 1 for a query of over 60."""
    path = F.length(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    query = F.length(F.regexp_extract(url, r"(\?[^#]*)", 1))
    return F.when(url.startswith("https://"), 2).otherwise(0) + F.when(path.between(6, 119), 1).otherwise(0) - F.when(query > 60, 1).otherwise(0)


def entity_name(name: Column) -> Column:
    """A company name in capitals without punctuation; 'and' and '&' are alike."""
    s = chain(F.upper(F.trim(name)), [(r"\s+", " "), (r"\bAND\b", "&"), (r"\s*&\s*", " AND "), (r"[^A-Z0-9\s&']", " ")])
    return one_space(s)


def entity_root(name: Column) -> Column:
    """The name without its trailing company words; the whole name if nothing else is left."""
    n = entity_name(name)
    root = F.trim(F.regexp_replace(n, rf"(\s*\b{SUFFIXES})+$", ""))
    return F.when(root == "", n).otherwise(root)


def street_address(address: Column) -> Column:
    # fixed values: abbreviations of street words
    words = {"STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD", "SUITE": "STE", "FLOOR": "FL", "APARTMENT": "APT"}
    s = chain(one_space(F.upper(address)), [(rf"\b{a}\b", b) for a, b in words.items()] + [(r",\s*", ", "), (r"[^A-Z0-9\s#,.\-']", " ")])
    return one_space(s)


def html_to_text(html: Column) -> Column:
    """Text of marked-up text by replacement alone: scripts and styles go, tags become blanks, the five basic entities
    and the blank are read; all on one line."""
    s = chain(html, [(r"(?is)<script.*?>.*?</script>", " "), (r"(?is)<style.*?>.*?</style>", " "), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&")])
    return one_space(s)


def html_to_lines(html: Column) -> Column:
    """Like html_to_text(), but ends of blocks, rows and lines end a line; empty lines go."""
    ends = F.regexp_replace(html, r"(?i)<(br|hr)\s*/?>|</(p|div|li|tr|table|h[1-6]|section|article|ul|ol|blockquote)\s*>", "\n")
    s = chain(ends, [(r"(?is)<script.*?>.*?</script>", " "), (r"(?is)<style.*?>.*?</style>", " "), (r"<[^>]+>", " "), ("(?i)&nbsp;|&#160;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;|&apos;", "'"), ("(?i)&amp;", "&")])
    lines = F.transform(F.split(s, "\n"), lambda x: one_space(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def upper_union(a: Column, b: Column) -> Column:
    """The distinct values of two arrays in capitals, first occurrences in order."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.array_distinct(F.transform(both, F.upper))


def plain_letters(text: Column) -> Column:
    """A text in compatibility decomposition (NFKD) without combining marks. ASCII texts stay in the JVM as they are."""

    @F.udf(StringType(), useArrow=True)
    def decomposed(text):
        import unicodedata

        return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(decomposed(text))


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text, from compact yyyyMMddTHHmmss, or from epoch seconds in digits; null for anything else."""
    t = F.trim(text)
    compact = F.when(t.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")))
    epoch = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("long")))
    return F.coalesce(compact, epoch, F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp")))


def rectangular(grid: Column) -> Column:
    """Rows of a grid filled with empty cells up to the longest."""
    width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def normal_space(text: Column) -> Column:
    """Line ends as \\n, no blanks before them, at most one empty line in a row."""
    return F.trim(chain(text, [(r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]), F.lit(" \t\n\x0b\x0c"))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n[ \t\n\x0B\f]*\n"), lambda p: F.trim(p, F.lit(" \t\n\x0b\x0c")))
    return F.filter(parts, lambda p: p != "")


def summary(text: Column, most: int = 280) -> Column:
    """The first sentence if it has at most so many characters, else the beginning with dots."""

    def told(t: Column) -> Column:
        first = F.trim(F.element_at(F.split(t, r"(?<=[.!?]) ", 2), 1))
        ended = lambda f: F.when(f.rlike(r"[.!?]$"), f).otherwise(F.concat(f, F.lit(".")))
        head = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)
        return F.when(F.substring(t, 1, 800).rlike(r"[.?!] "), once(first, lambda f: F.when(F.length(f) <= most, ended(f)).otherwise(head))).otherwise(head)

    return once(one_space(text), told)


def numbers_and_dates(text: Column, most: int = 24) -> Column:
    """Distinct dates, quarters, fiscal years, grouped numbers, amounts and percentages, kind after kind."""
    # fixed values: the patterns, in the order in which they count
    patterns = [
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
        r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{4}\b",
        r"(?i)\bQ[1-4]\s*'?[0-9]{2,4}\b",
        r"(?i)\bFY\s*'?[0-9]{2,4}\b",
        r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b",
        r"\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b",
        r"(?i)\$\s*[0-9]+(?:\.[0-9]+)?(?:\s*(?:million|billion|M|B))?\b",
        r"\b[0-9]+(?:\.[0-9]+)?\s*%\b",  # a word must follow the sign
    ]
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    return F.slice(distinct_in_order(F.transform(found, lambda x: F.trim(x))), 1, most)


def capital_phrases(text: Column, most: int = 16) -> Column:
    """Candidates for names: phrases of capitalised words, then words in capitals; the first of each spelling."""
    phrases = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP))
    found = F.concat(phrases, F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,12}\b"), F.lit(0)))
    return F.slice(first_by(found, F.lower), 1, most)


def tokens(text: Column) -> Column:
    """Words for ranking: lower case, without URLs, of two characters or more, without stop words; repeats stay."""
    s = chain(F.lower(F.coalesce(text, F.lit(""))), [(r"https?://\S+", " "), (r"[^a-z0-9$%.\-+/\s]", " ")])
    return F.filter(F.split(one_space(s), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*RANK_STOP))


def links(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("https?://[^\\s\"'<>)]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:]+$", "")))


def financial_number(cell: Column) -> Column:
    """A number from a cell: (1,234) is negative, dashes and blanks are null, $ and commas go, a percent sign divides."""
    s = F.regexp_replace(F.trim(cell), r"[$,\s]", "")
    bare = F.regexp_replace(s, r"[()%]", "")
    value = bare.try_cast("double")
    signed = F.when(s.rlike(r"^\(.*\)%?$"), -value).otherwise(value)
    return F.when(s.endswith("%"), signed / 100).otherwise(signed)


def short_id(length: int, *parts: Column) -> Column:
    """The first digits of a SHA-256 over the parts, joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def hash31(text: Column) -> Column:
    """The 32-bit hash h = 31 h + unit over the characters of a text in the basic plane."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def json_in_text(text: Column, schema: str) -> Column:
    """The first JSON object in a text that may be fenced or surrounded by words; null if there is none."""
    bare = F.regexp_replace(text, r"(?s)```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def quarter_label_of(label: Column) -> Column:
    """Qn yyyy from labels such as 2020Q1, Q1-2020, 1Q 2020 or 2020-03-31; the label itself where none fits."""
    q, y = F.regexp_extract(label, r"(?i)(?:Q([1-4]))", 1), F.regexp_extract(label, r"((?:19|20)\d\d)", 1)
    lead = F.regexp_extract(label, r"(?i)^([1-4])Q", 1)
    day = F.try_to_date(F.regexp_extract(label, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    n = F.when(lead != "", lead).when(q != "", q)
    return F.when(n.isNotNull() & (y != ""), F.concat(F.lit("Q"), n, F.lit(" "), y)).when(day.isNotNull(), F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))).otherwise(label)


def any_of_query(terms: Column) -> Column:
    """A query of alternatives: terms with blanks in quotes, joined by OR."""
    return F.array_join(F.transform(terms, lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " OR ")


def markdown_sections(text: Column) -> Column:
    """Titles of the second-level headings of a Markdown text, in order."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^## +\S")), lambda x: F.trim(F.regexp_replace(x, r"^## +", "")))


def bracket_pairs(text: Column) -> Column:
    """(name, place) pairs from a run such as 'Name (Place) Name (Place)'."""
    names = F.regexp_extract_all(text, F.lit(r"([^()]+)\(([^()]+)\)"), F.lit(1))
    places = F.regexp_extract_all(text, F.lit(r"([^()]+)\(([^()]+)\)"), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), places.alias("p")), lambda x: F.struct(F.trim(F.regexp_replace(x["n"], "^[,; ]+", "")).alias("name"), F.trim(x["p"]).alias("place")))


def inner_word(text: Column) -> Column:
    """The longest word of a text that has a blank on either side, the first of equals; null for none. Where such a
    text lies in another, that word is one of the other's."""
    words = F.split(text, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.try_element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
