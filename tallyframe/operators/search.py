"""Federated search: normalise hits, find duplicates, merge them, score and rank."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import keep, periods, rules, text as tx
from tallyframe.session import Scratch, ship


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a and b for all pairs of sets (id, words) whose Jaccard similarity is at least threshold, both ways.

    Two such sets share one of their rarest words, so pairs come from a join on those alone (as many as the threshold
    leaves open), never on the common ones."""
    each = sets.select("id", F.explode("words").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("r"))
    first = F.size("r") - F.ceil(threshold * F.size("r")) + 1
    rare = ranked.select("id", F.size("r").alias("size"), F.explode(F.slice("r", 1, first.cast("int"))).alias("x")).select("id", "size", "x.word")
    a, b = (rare.select("word", F.col("id").alias(c), F.col("size").alias(f"s{c}")) for c in "ab")
    sized = F.least("sa", "sb") >= threshold * F.greatest("sa", "sb")
    pairs = a.join(b, "word").where((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    left, right = (sets.select(F.col("id").alias(c), F.col("words").alias(f"w{c}")) for c in "ab")
    found = pairs.join(left, "a").join(right, "b").where(tx.jaccard(F.col("wa"), F.col("wb")) >= threshold).select("a", "b")
    return found.union(found.select("b", "a"))


#: Open rows, and pairs of their groups, that one task decides at the end; with more, rounds over all tasks go on.
REST_ROWS, REST_PAIRS = 200_000, 4_000_000


def greedy_clusters(hits: DataFrame, key: str, url: str, words: str, at: str, order: list[Column], threshold: float = 0.82, hours: float = 2.0, group: str | None = None) -> DataFrame:
    """key and cluster: rows are taken in order; each joins the first head that is a duplicate of it, or becomes a head.
    Duplicates have one URL in normal form, or word sets (of their titles) with a Jaccard similarity of at least
    threshold and times within so many hours. Rows without URL, words or time are duplicates of none by these. With a
    group (such as a broker) only rows of one group can be duplicates.

    Exact, without comparing all rows: rows of one URL are duplicates of each other, and so are rows of one word set
    within one span of hours; such a group has at most one head. First the heads are found: in each round a row is one
    if it is the first open one of its groups and of the groups of similar sets nearby, and what a new head has for
    duplicates is open no more, whichever head it joins. Then each row looks up the first of the heads around it. A last part of bounded size is decided by one
    task, since it may be a long chain."""
    made = Scratch(hits.sparkSession, "clusters")
    span = hours * 3600
    link = F.coalesce(tx.match_url(F.col(url)), F.when(F.trim(url) != "", F.lower(F.trim(url))))
    t = F.col(at).cast("timestamp").cast("double")
    full = (F.size(words) > 0) & t.isNotNull()
    sorted_words = F.array_sort(F.array_distinct(words))
    if group is not None:
        link = F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(" "), link)
    own = F.col(group).cast("string") if group is not None else F.lit(None).cast("string")
    joined = F.array_join(sorted_words, " ")
    rows = hits.select(F.col(key).alias("k"), F.struct(*order, F.col(key).alias("__key")).alias("o"), t.alias("t"), link.alias("u"), F.when(full, F.xxhash64(joined, own)).alias("w"), F.when(full, F.floor(t / span)).alias("b"), F.when(full, F.xxhash64(joined)).alias("v"), F.when(full, sorted_words).alias("words"), own.alias("g"))
    rows = made.write(rows, "rows")
    groups = made.write(rows.where("w is not null").groupBy("w", "b").agg(F.first("v").alias("v"), F.first("words").alias("words"), F.first("g").alias("g")), "groups")
    each = made.write(groups.groupBy("v").agg(F.first("words").alias("words")).withColumnRenamed("v", "id"), "sets")
    alike = each.select(F.col("id").alias("v"), F.col("id").alias("nv")).union(similar_sets(each, threshold).toDF("v", "nv"))
    sets = groups.groupBy("w").agg(F.first("v").alias("v"), F.first("g").alias("g"))
    sets = sets.withColumn("none", F.col("g").isNull()).withColumn("g", F.coalesce("g", F.lit("")))  # groups meet by an equi-join, also the missing one
    alike = sets.join(alike, "v").drop("v").join(sets.select(F.col("w").alias("nw"), F.col("v").alias("nv"), "g", "none"), ["nv", "g", "none"]).select("w", "nw")
    near = groups.select("w", "b").join(alike, "w").withColumn("nb", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    near = made.write(near.join(groups.select(F.col("w").alias("nw"), F.col("b").alias("nb")), ["nw", "nb"]).select("w", "b", "nw", "nb"), "near")
    made.drop("groups", "sets")
    rows = rows.drop("v", "words", "g")
    # rows without a URL or words have join keys of their own, so that they don't meet in one task
    lone = F.coalesce("u", F.concat(F.lit("\n"), F.col("k").cast("string"))).alias("lu"), F.coalesce("w", F.xxhash64("k")).alias("lw")
    open_rows = made.write(rows.where("u is not null or w is not null"), "open")
    found, n_open = [], open_rows.count()
    while n_open:
        nearby = near if n_open > REST_ROWS else _between(near, open_rows, made)
        if n_open <= REST_ROWS and nearby.count() <= REST_PAIRS:
            found.append(made.write(_rest_heads(open_rows, nearby, span), f"heads{len(found)}"))
            break
        first_u = open_rows.where("u is not null").groupBy("u").agg(F.min("o").alias("fu"))
        first_w = open_rows.where("w is not null").groupBy("w", "b").agg(F.min(F.struct("o", "k", "t", "u")).alias("r"))
        around = near.join(first_w.select(F.col("w").alias("nw"), F.col("b").alias("nb"), F.col("r.o").alias("fw")), ["nw", "nb"]).groupBy("w", "b").agg(F.min("fw").alias("fw"))
        worded = first_w.join(around, ["w", "b"]).where(F.col("r.o") == F.col("fw")).select("r.k", "r.o", "r.t", "r.u", "w", "b")
        bare = open_rows.where("w is null").groupBy("u").agg(F.min(F.struct("o", "k", "t")).alias("r")).select("r.k", "r.o", "r.t", "u", F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("b"))
        tried = worded.union(bare)
        heads = tried.where("u is null").union(tried.join(first_u, "u").where(F.col("o") == F.col("fu")).select(*tried.columns))
        heads = made.write(heads, f"heads{len(found)}")
        found.append(heads)
        reach = heads.where("w is not null").select(F.col("w").alias("nw"), F.col("b").alias("nb"), F.col("t").alias("ht")).join(near, ["nw", "nb"]).select(F.col("w").alias("hw"), F.col("b").alias("hb"), "ht")
        left = open_rows.select("*", *lone).join(heads.select(F.col("u").alias("lu")).where("lu is not null"), "lu", "left_anti")
        left = left.join(reach, (F.col("lw") == F.col("hw")) & (F.col("b") == F.col("hb")) & (F.abs(F.col("t") - F.col("ht")) <= span), "left_anti")
        open_rows = made.write(left.select(*rows.columns), "open")
        n_open = open_rows.count()
    heads = rows.limit(0)
    for part in found:
        heads = heads.union(part.select(*rows.columns))
    by_url = heads.where("u is not null").select(F.col("u").alias("lu"), F.struct("o", "k").alias("hu"))
    by_words = heads.where("w is not null").select(F.col("w").alias("nw"), F.col("b").alias("nb"), F.struct("o", "k", "t").alias("h")).join(near, ["nw", "nb"]).groupBy(F.col("w").alias("lw"), "b").agg(F.array_sort(F.collect_list("h")).alias("hw"))  # at most a head for each group nearby
    all_rows = rows.select("*", *lone).join(by_url, "lu", "left").join(by_words, ["lw", "b"], "left")
    fit = F.get(F.filter("hw", lambda h: (h["o"] <= F.col("o")) & (F.abs(h["t"] - F.col("t")) <= span)), F.lit(0))
    head = F.least(F.when(F.col("hu.o") <= F.col("o"), F.col("hu")), F.when(fit.isNotNull(), F.struct(fit["o"].alias("o"), fit["k"].alias("k"))))
    out = made.write(all_rows.select(F.col("k").alias(key), F.coalesce(head["k"], F.col("k")).alias("cluster")), "clusters")
    made.drop("rows", "near", "nearby", "open", *[f"heads{i}" for i in range(len(found))])
    return out


def _between(near: DataFrame, open_rows: DataFrame, made: Scratch) -> DataFrame:
    """The part of near that lies between groups with open rows."""
    groups = open_rows.where("w is not null").select("w", "b").distinct()
    left = near.join(groups, ["w", "b"]).join(groups.select(F.col("w").alias("nw"), F.col("b").alias("nb")), ["nw", "nb"])
    return made.write(left.select("w", "b", "nw", "nb"), "nearby")


def _rest_heads(open_rows: DataFrame, nearby: DataFrame, span: float) -> DataFrame:
    """The heads of at most REST_ROWS open rows with REST_PAIRS pairs of groups, in order, by one task."""
    ship(open_rows.sparkSession)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        urls: set = set()
        times: dict = {}
        for batch in batches:
            keep = []
            for at, (u, own, t, around) in enumerate(zip(batch["u"], batch["own"], batch["t"], batch["around"])):
                if u is not None and u in urls or around is not None and any(abs(times.get(g, float("inf")) - t) <= span for g in around.tolist()):
                    continue
                keep.append(at)
                if u is not None:
                    urls.add(u)
                if around is not None:
                    times[int(own)] = t
            yield batch.iloc[keep][["place"]]

    around = nearby.groupBy("w", "b").agg(F.xxhash64("w", "b").alias("own"), F.collect_list(F.xxhash64("nw", "nb")).alias("around"))
    whole = Window.partitionBy(F.lit(0)).orderBy("o")
    placed = open_rows.withColumn("place", F.row_number().over(whole))
    first = placed.join(around, ["w", "b"], "left").select("place", "u", F.coalesce("own", F.lit(0)).alias("own"), "t", "around").repartition(1).sortWithinPartitions("place").mapInPandas(heads, "place int")
    return placed.join(first, "place").select(*open_rows.columns)


def merge_clusters(hits: DataFrame, cluster: str, order: list[str]) -> DataFrame:
    """One row per cluster. hits: title, url, summary, provider, score, at, priority. Rows are folded in order: the
    best URL by quality and the longest title and summary win (the earlier on ties), providers unite, the mean score
    is pairwise (each row weighs as much as all before it), the latest time and the least priority stay."""
    fields = [c for c in ("title", "url", "summary", "provider", "score", "at", "priority") if c not in order]
    entry = F.struct(*order, *fields, tx.url_quality(F.col("url")).alias("q"))
    folded = hits.groupBy(cluster).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    best = lambda field, size: F.aggregate("all", F.get("all", F.lit(0))[field], lambda a, x: F.when(size(x[field]) > size(a), x[field]).otherwise(a))
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    url = F.aggregate("all", F.struct(F.get("all", F.lit(0))["url"].alias("url"), F.get("all", F.lit(0))["q"].alias("q")), lambda a, x: F.when(x["q"] > a["q"], F.struct(x["url"].alias("url"), x["q"].alias("q"))).otherwise(a))["url"]
    mean = F.aggregate("all", F.lit(None).cast("double"), lambda a, x: F.coalesce((a + x["score"]) / 2, a, x["score"]))
    return folded.select(
        cluster, F.size("all").alias("n"), best("title", length).alias("title"), url.alias("url"), best("summary", length).alias("summary"),
        F.array_sort(F.array_distinct(F.transform("all", lambda x: x["provider"]))).alias("providers"), mean.alias("score"),
        F.array_max(F.transform("all", lambda x: x["at"])).alias("at"), F.array_min(F.transform("all", lambda x: x["priority"])).alias("priority"),
    )


def two_pass_best(hits: DataFrame, first: str, second: list[str], order: list[Column]) -> DataFrame:
    """The best row of each first key (rows without one all stay), then of those the best of each second key."""
    keyed = keep.keep_first(hits.where(F.col(first).isNotNull()), [first], order).unionByName(hits.where(F.col(first).isNull()))
    return keep.keep_first(keyed, second, order)


def keyed_merge(hits: DataFrame, key: str, score: str, sets: list[str], tie: str) -> DataFrame:
    """One row per key: the one of the highest score (ties: least tie), with each of sets united over all rows."""
    united = hits.groupBy(key).agg(F.max_by(F.struct(*[c for c in hits.columns if c not in (key, *sets)]), F.struct(F.col(score), -F.col(tie))).alias("b"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets], F.count("*").alias("n_hits"))
    return united.select(key, "b.*", *sets, "n_hits")


def headline_dedupe(items: DataFrame, title: str, rank: str, at: str, key: str) -> DataFrame:
    """Of items with one normal title that of the best source rank, the newer on ties."""
    keyed = items.withColumn("__t", tx.match_title(F.col(title)))
    return keep.keep_last(keyed, ["__t"], [-F.col(rank), F.col(at), F.col(key)]).drop("__t")


def mentions(blob: Column, ticker: str, company: str) -> Column:
    """mixed, company, ticker or none: how a text names a company. The ticker counts as a word or after a $."""
    t = blob.rlike(rf"\b{ticker}\b|\${ticker}\b")
    words = [w for w in company.lower().split() if len(w) >= 3]
    low = F.lower(blob)
    long = [low.rlike(rf"\b{w}\b") for w in words if len(w) >= 4]
    n = sum((F.when(low.rlike(rf"\b{w}\b"), 1).otherwise(0) for w in words), F.lit(0))
    c = (n >= 2) if not long else (n >= 2) | long[0]
    return F.when(t & c, "mixed").when(c, "company").when(t, "ticker").otherwise("none")


def any_of(terms: list[str]) -> str:
    return " OR ".join(f'"{t}"' if " " in t else t for t in terms)


def merge_hits(hits: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Hits of both sides by key: the longer snippet stays (the first side's on ties), queries are joined."""
    a = hits.select(key, F.col("snippet").alias("s1"), F.col("query").alias("q1"))
    b = extra.select(key, F.col("snippet").alias("s2"), F.col("query").alias("q2"))
    both = a.join(b, key, "full")
    size = lambda c: F.coalesce(F.length(c), F.lit(-1))
    return both.select(key, F.when(size("s2") > size("s1"), F.col("s2")).otherwise(F.col("s1")).alias("snippet"), F.concat_ws(" | ", "q1", "q2").alias("query"))


def expand_queries(rows: DataFrame, query: str, scopes: list[str]) -> DataFrame:
    """Each query once for each scope of a short fixed list, the scope added as a site."""
    return rows.withColumn("scope", F.explode(F.array(*[F.lit(x) for x in scopes]))).withColumn("scoped", F.concat(query, F.lit(" site:"), "scope"))


def rank_hits(hits: DataFrame, mode: str, score: str, at: str, name: str, key: str, take: int) -> DataFrame:
    """The first hits by a mode: relevance (score, then newest), recent (newest, then score) or name (name, then
    newest); ties by key, hits without time last."""
    newest, best = F.desc_nulls_last(at), F.desc(score)
    order = {"relevance": [best, newest], "recent": [newest, best], "name": [F.asc(F.lower(name)), newest]}[mode]
    return hits.orderBy(*order, key).limit(take)


def merge_sources(stored: DataFrame, live: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Rows of both sides by key: arrays unite, other fields are the stored side's where it has them; source says stored,
    live or merged."""
    rest = [c for c in stored.columns if c != key and c not in arrays]
    a = stored.select(key, *[F.col(c).alias(f"a_{c}") for c in (*rest, *arrays)], F.lit(True).alias("in_a"))
    b = live.select(key, *[F.col(c).alias(f"b_{c}") for c in (*rest, *arrays)], F.lit(True).alias("in_b"))
    none = F.array().cast("array<string>")
    source = F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), "merged").when(F.col("in_a").isNotNull(), "stored").otherwise("live")
    both = a.join(b, key, "full")
    return both.select(key, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in rest], *[F.array_sort(F.array_union(F.coalesce(f"a_{c}", none), F.coalesce(f"b_{c}", none))).alias(c) for c in arrays], source.alias("source"))
