"""Research helpers: company name search, document classes, evidence scores, candidates, rule maps and reshaping."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import keep, rules, text as tx

def name_rank(title: Column, query: str) -> Column:
    """How well a name fits a query, both in normal form: 100 equal, 85 at the start, up to 70 inside, up to 72 the other
    way round for names of 8 characters or more, 55 if every word of the query occurs, else 0."""
    # fixed values: the points
    q = " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in query.lower()).split())
    t = tx.one_space(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "))
    at, back = F.instr(t, q) - 1, F.instr(F.lit(q), t) - 1
    words = [w for w in q.split() if len(w) >= 2]
    every = F.lit(bool(words))
    for w in words:
        every = every & t.contains(w)
    return (
        F.when(t == q, 100).when(t.startswith(q), 85).when(at >= 0, 70 - F.least(F.lit(25), at))
        .when((F.length(t) >= 8) & (back >= 0), 72 - F.least(F.lit(20), back)).when(every, 55).otherwise(0)
    )


def search_companies(entries: DataFrame, name: str, query: str, most: int, key: str) -> DataFrame:
    """The companies that fit a query best: a scan with a partial top-k per task."""
    return entries.withColumn("rank", name_rank(F.col(name), query)).where("rank > 0").orderBy(F.desc("rank"), F.length(name), key).limit(most)


def best_alias(names: DataFrame, name: str, aliases: Sequence[str]) -> DataFrame:
    """Adds alias_score, the greatest of bigram likeness and word overlap of a name with any alias (a short constant
    list). Both are compared in plain lower-case letters and digits; words of two letters or fewer don't overlap."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(tx.plain_letters(F.lower(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))
    named = names.withColumn("__name", plain(F.coalesce(F.col(name), F.lit(""))))
    told = [" ".join(re.sub(r"[^a-z0-9\s]", " ", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", a.lower()))).split()) for a in aliases]
    scores = [s for a in told for s in (tx.dice(F.col("__name"), F.lit(a)), tx.overlap(words(F.col("__name")), words(F.lit(a))))]
    return named.withColumn("alias_score", F.greatest(*scores, F.lit(0.0))).drop("__name")


def confidence(evidence: dict[str, Column]) -> Column:
    """high, medium, low or unknown from flags: agent_only, listed, registry, in_documents, lien, root_and_address,
    root_and_officer, root_and_financing, name_only, no_source."""
    e = {k: F.coalesce(v, F.lit(False)) for k, v in evidence.items()}
    has = lambda *names: _any([e[n] for n in names if n in e])
    return (
        F.when(has("agent_only") & ~has("in_documents", "lien"), "low").when(has("listed", "registry", "in_documents", "lien"), "high")
        .when(has("root_and_address", "root_and_officer", "root_and_financing"), "medium").when(has("name_only", "no_source"), "low").otherwise("unknown")
    )


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def candidates(sources: list[DataFrame], key: Column, cap: int | None, pos: str) -> DataFrame:
    """Candidates of several sources, the first source's first row for each key, in that order; at most cap."""
    parts = [df.withColumn("__src", F.lit(i)) for i, df in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = keep.keep_first(rows.withColumn("__key", key), ["__key"], ["__src", pos]).drop("__key")
    return (first.orderBy("__src", pos).limit(cap) if cap else first).withColumnRenamed("__src", "source_rank")


def merge_fieldwise(old: DataFrame, new: DataFrame, key: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """Rows of both: a scalar that is there stays, arrays unite without regard to case (first spelling stays)."""
    a = old.select(key, *[F.col(c).alias(f"o_{c}") for c in (*scalars, *arrays)])
    b = new.select(key, *[F.col(c).alias(f"n_{c}") for c in (*scalars, *arrays)])
    both = a.join(b, key, "full")
    blank = lambda c: F.when(F.trim(c) != "", c)
    none = F.array().cast("array<string>")

    def united(c: str) -> Column:
        every = F.concat(F.coalesce(f"o_{c}", none), F.coalesce(f"n_{c}", none))
        return tx.first_by(every, lambda x: F.lower(F.trim(x)))

    return both.select(key, *[F.coalesce(blank(F.col(f"o_{c}")), F.col(f"n_{c}")).alias(c) for c in scalars], *[united(c).alias(c) for c in arrays])


def recommend_sources(profile: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Sources for each profile: those of one of its states or of none. profile: key, states; sources: source, state,
    priority. One null-safe equi-join: each profile's states and a null, which meets the sources without a state."""
    states = F.array_union(F.coalesce("states", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    each = profile.select(key, F.explode(states).alias("__state"))
    own = each.join(sources, F.col("__state").eqNullSafe(F.col("state")))
    return own.groupBy(key, "source").agg(F.min("priority").alias("priority"))


def pivot_series(records: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """One row per metric, one map from column label to value: wide records turned round."""
    long = records.unpivot([label], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "value")))).alias("values"))


def heading_score(parts: list[tuple[str, float]], text: Column, most: float) -> Column:
    """Points of the patterns found, at most so many."""
    return rules.additive([(F.coalesce(text.rlike(p), F.lit(False)), points) for p, points in parts], None, most)


def merge_candidates(rows: DataFrame, keys: list[str], scores: list[str], path: str) -> DataFrame:
    """Candidates with one extent: the greatest of each score, all paths, the total of the scores."""
    out = rows.groupBy(*keys).agg(*[F.max(s).alias(s) for s in scores], F.array_sort(F.collect_set(path)).alias("paths"))
    return out.withColumn("total", sum((F.coalesce(F.col(s), F.lit(0)) for s in scores[1:]), F.coalesce(F.col(scores[0]), F.lit(0))))


def nearest_shallower(rows: DataFrame, keys: list[str], pos: str, depth: str, depths: int) -> DataFrame:
    """Adds parent: the nearest earlier row of less depth. One running value per depth (depths of a statement are few)."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(depth) == d, F.col(pos))).over(w) for d in range(depths)]
    found = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.when(F.lit(d) < F.col(depth), last[d]) for d in range(depths)])
    return rows.withColumn("parent", found)


def same_period(columns: DataFrame, key: str, want_start: str | None, want_end: str) -> DataFrame:
    """The column of each key that fits a period best, of those that end with it: the one with its start, else the only
    one, else the first of 300 to 400 days, else the first; null where none ends with it. columns: key, idx, start, end."""
    days = F.datediff("end", "start") + 1
    fit = F.when(F.coalesce(F.col("start") == F.lit(want_start), F.lit(False)), 0).when(days.between(300, 400), 1).otherwise(2)  # an only one wins whatever it is
    best = columns.where(F.col("end") == want_end).groupBy(key).agg(F.min_by("idx", F.struct(fit, "idx")).alias("idx"))
    return columns.select(key).distinct().join(best, key, "left")


def grid_lookup(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (want, period, label) the first cell of the period whose label contains it, in any case. cells: pos,
    period, label, value. A label that has a whole word inside meets the cells with that word only; equal labels of a
    period are looked up once, and of cells with equal labels the first."""
    w = wanted.select("want", "period", F.lower("label").alias("w"))
    asked = w.select("period", "w").distinct().withColumn("word", tx.inner_word(F.col("w")))
    named = cells.groupBy("period", F.lower("label").alias("l")).agg(F.min_by(F.struct("pos", "value"), "pos").alias("c"))
    words = named.select("period", F.explode(F.array_distinct(F.split("l", " "))).alias("word"), "l", "c")
    by_word = asked.where("word is not null").join(words, ["period", "word"]).select("period", "w", "l", "c")
    rest = asked.where("word is null").select("period", "w").join(named, "period")
    best = by_word.unionByName(rest).where(F.col("l").contains(F.col("w"))).groupBy("period", "w").agg(F.min_by("c", "c.pos").alias("c"))
    return w.join(best, ["period", "w"]).select("want", "period", "c.value")


def facet_counts(pages: DataFrame, entity: str, count: str, pos: str) -> DataFrame:
    """Counts by entity over the pages of a search; spellings that differ in case or blanks are one, the first stays."""
    folded = F.lower(tx.one_space(F.col(entity)))
    return pages.where(folded != "").groupBy(folded.alias("__e")).agg(F.min_by(F.trim(entity), pos).alias(entity), F.sum(count).alias(count)).drop("__e")


def table_scores(tables: DataFrame, part: str, text: Column, keywords: list[tuple[str, float]], cap: float) -> DataFrame:
    """Per part of a document: best (the highest score of its tables) and total (the sum of their scores, each at most cap)."""
    scored = tables.select(part, heading_score(keywords, text, float("inf")).alias("__s"))
    return scored.groupBy(part).agg(F.max("__s").alias("best"), F.sum(F.least(F.lit(cap), "__s")).alias("total"))


def rank_facilities(facilities: DataFrame, score: Column, name: str, take: int = 80) -> DataFrame:
    """The facilities of the highest scores, then by name, at most so many."""
    return facilities.withColumn("score", score).orderBy(F.desc("score"), name).limit(take)


def rank_files(files: DataFrame, name: str, score: Column, least: float = 50) -> DataFrame:
    """Files with at least so many points and their rank: by points, then by name. Each filing has few."""
    return files.withColumn("score", score).where(F.col("score") >= least)


def first_valid(candidates_: DataFrame, key: str, order: list[str], valid: Column) -> DataFrame:
    """The first candidate of each key that is valid: newer filings before older ones, better names before worse."""
    return keep.keep_first(candidates_.where(valid), [key], order)


def year_range(rows: DataFrame, year: Column, first: int, last: int) -> DataFrame:
    """Rows of the years, by year; rows without one go."""
    return rows.withColumn("__y", year).where(F.col("__y").between(first, last)).drop("__y")


def name_sets(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """The distinct names of both sides in normal form, and on which side each is."""
    a, b = (df.select(tx.entity_name(F.col(name)).alias("norm")).where("norm <> ''").distinct().withColumn(side, F.lit(True)) for df, side in ((left, "in_left"), (right, "in_right")))
    return a.join(b, "norm", "full").select("norm", F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def merge_names(base: DataFrame, extra: DataFrame, name: str, pos: str, excluded: DataFrame | None = None) -> DataFrame:
    """Names of base, then of extra, once whatever their case and without those excluded: name and source (0 or 1)."""
    folded = lambda c: F.lower(F.trim(c))
    both = base.select(name, pos, F.lit(0).alias("source")).unionByName(extra.select(name, pos, F.lit(1).alias("source"))).where(F.trim(name) != "")
    keyed = both.withColumn("__k", folded(F.col(name)))
    if excluded is not None:
        keyed = keyed.join(excluded.select(folded(F.col(name)).alias("__k")), "__k", "left_anti")
    return keep.keep_first(keyed, ["__k"], ["source", pos]).select(F.trim(name).alias(name), "source")


def statement_grid(facts: DataFrame) -> DataFrame:
    """line, fy, value and sort_order: the first value of each standard line and year, in the facts' order. facts: pos,
    statement, concept, fy, value. Concepts without a rule have lines of their own, last."""
    line = rules.standard_line(F.col("concept"), F.col("statement"))
    rows = facts.where("value is not null").select("pos", "statement", "fy", "value", line["line"].alias("line"), line["sort_order"].alias("sort_order"))
    return rows.groupBy("statement", "line", "fy").agg(F.min_by("value", "pos").alias("value"), F.min("sort_order").alias("sort_order"))


def merge_ordered(facts: DataFrame, keys: list[str], filed: str, pos: str) -> DataFrame:
    """One fact per key: of the last filing, and in it the first."""
    return keep.keep_first(facts, keys, [-F.col(filed), F.col(pos)])


def latest_periods(periods_: DataFrame, keys: list[str], filed: str, end: str) -> DataFrame:
    """One row per period key, the last filed, newest end first."""
    return keep.keep_last(periods_, keys, [filed]).orderBy(F.desc(end), *keys)
