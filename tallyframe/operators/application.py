"""Application queries: inboxes, unread counts, pages, quotas, upserts, retention, bounded partitions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.keep import keep_last, rounded_mean
from tallyframe.session import ship


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old with rows of new replaced or added by key; of several new rows of a key that of the greatest seq."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return keep_last(both, keys, ["__new", seq]).drop("__new")


def retain_last_keys(rows: DataFrame, owner: str, key: str, most: int) -> DataFrame:
    """Rows of each owner's last so many distinct keys."""
    keys = rows.select(owner, key).distinct()
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(key)))
    return rows.join(keys.withColumn("__n", nth).where(F.col("__n") <= most).drop("__n"), [owner, key], "left_semi")


def retain_newest(rows: DataFrame, owner: str, order: list[Column], most: int) -> DataFrame:
    """The newest so many rows of each owner. The window is a top-k: Spark limits each task's groups before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.withColumn("__n", nth).where(F.col("__n") <= most).drop("__n")


def storage_bytes(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Bytes per owner summed over tables: parts are (table, owner column, text or binary column)."""
    sums = [df.groupBy(F.col(owner).alias("owner")).agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).cast("long").alias("bytes")) for df, owner, col in parts]
    return reduce(DataFrame.unionByName, sums).groupBy("owner").agg(F.sum("bytes").alias("bytes"))


def within_quota(used: DataFrame, delta: DataFrame, quota: int) -> DataFrame:
    """Per owner of delta whether the bytes used and the net change stay within quota. delta: owner, delta."""
    out = delta.join(used, "owner", "left").withColumn("total", F.coalesce("bytes", F.lit(0)) + F.col("delta"))
    return out.select("owner", "total", ((F.col("total") <= quota) | (F.col("delta") <= 0)).alias("allowed"))


def unread_counts(members: DataFrame, messages: DataFrame) -> DataFrame:
    """Per member, the messages after the last one read (or after joining), by others, visible to the member.

    members: conv, user, joined_at, last_read_at; messages: conv, sender, at, visible_to."""
    after = F.col("at") > F.coalesce("last_read_at", "joined_at")
    seen = (F.col("visible_to").isNull() | (F.col("visible_to") == F.col("user"))) & (F.col("sender") != F.col("user"))
    out = members.join(messages, "conv", "left").groupBy("conv", "user").agg(F.count_if(after & seen).alias("unread"))
    return out


def latest_per_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_last(rows, keys, order)


def replies(messages: DataFrame, key: str, parent: str, shown: list[str]) -> DataFrame:
    """Messages with the columns shown of the message they answer (null if it is gone)."""
    parents = messages.select(F.col(key).alias(parent), *[F.col(c).alias(f"parent_{c}") for c in shown])
    return messages.join(parents, parent, "left")


def page_before(rows: DataFrame, order: str, cursor: Column | None, take: int) -> DataFrame:
    """The newest rows strictly before the cursor, at most so many (1 to 100)."""
    rows = rows if cursor is None else rows.where(F.col(order) < cursor)
    return rows.orderBy(F.desc(order)).limit(min(100, max(1, take)))


def search_users(users: DataFrame, term: str, fields: list[str], order: list[str], take: int) -> DataFrame:
    """Of the first so many users (by order) those with the term in a field, sorted by the fields in lower case. The
    limit comes before the filter."""
    first = users.orderBy(*order).limit(take)
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(f, F.lit(""))).contains(term.lower()) for f in fields])
    return first.where(hit).orderBy(*[F.lower(f) for f in fields], *order)


def next_fit(rows: DataFrame, owner: str, order: str, size: str, most: int) -> DataFrame:
    """Rows of each owner in order, filled into parts of at most so many bytes; a larger row is a part alone. Returns
    owner, order and part. Every cut depends on those before, so an owner's rows pass one after the other through one
    task, which holds nothing but the open part."""
    ship(rows.sparkSession)
    types = {c: rows.schema[c].dataType.simpleString() for c in (owner, order)}
    given = rows.select(F.col(owner).cast("string").alias("w"), F.col(order).cast("string").alias("k"), F.col(size).cast("long").alias("s"), F.col(order).alias("o"))
    dealt = given.repartition("w").sortWithinPartitions("w", "o").select("w", "k", "s")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, used = object(), -1, 0
        for batch in batches:
            parts = []
            for w, s in zip(batch["w"], batch["s"]):
                if w != now:
                    now, part, used = w, -1, most + 1
                fits = part >= 0 and used + s <= most
                part, used = (part, used + s) if fits else (part + 1, s)
                parts.append(part)
            yield pd.DataFrame({"w": batch["w"], "k": batch["k"], "part": parts})

    found = dealt.mapInPandas(fill, "w string, k string, part int")
    return found.select(F.col("w").cast(types[owner]).alias(owner), F.col("k").cast(types[order]).alias(order), "part")


def counts_with_zeros(rows: DataFrame, key: str, domain: list) -> DataFrame:
    """Count per value of a fixed domain, 0 where there is none."""
    whole = rows.sparkSession.createDataFrame([(x,) for x in domain], [key])
    return whole.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def merge_preferences(server: DataFrame, legacy: DataFrame, owner: str, prefs: str) -> DataFrame:
    """Maps of both sides per owner; the server's values win."""
    both = server.select(owner, F.col(prefs).alias("s")).join(legacy.select(owner, F.col(prefs).alias("l")), owner, "full")
    empty = F.create_map().cast("map<string,string>")
    s, old = F.coalesce("s", empty), F.coalesce("l", empty)
    return both.select(owner, F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(s, k)), s).alias(prefs))


def summary(rows: DataFrame, keys: list[str], counts: dict[str, Column], distinct: dict[str, Column], means: dict[str, Column], digits: int = 1) -> DataFrame:
    """Per key how many rows meet each condition, how many distinct values each column has, and rounded means of the
    values that are there (null for none)."""
    parts = [F.count_if(c).alias(n) for n, c in counts.items()] + [F.countDistinct(c).alias(n) for n, c in distinct.items()] + [rounded_mean(c, digits).alias(n) for n, c in means.items()]
    return rows.groupBy(*keys).agg(*parts)


def inbox(conversations: DataFrame, lobby: Column, updated: str, key: str, take: int = 100) -> DataFrame:
    """A member's conversations: lobbies first, then the last updated, at most so many."""
    return conversations.withColumn("is_lobby", F.coalesce(lobby, F.lit(False))).orderBy(F.desc("is_lobby"), F.desc(updated), key).limit(take)


def visible(rows: DataFrame, to: str, viewer: Column, at: str, joined: Column) -> DataFrame:
    """Rows that are for everyone or for the viewer, from the time the viewer joined on."""
    return rows.where((F.col(to).isNull() | (F.col(to) == viewer)) & (F.col(at) >= joined))


def replace_all(rows: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """rows with all of the owners in new replaced by new's; owners without new rows keep theirs."""
    return rows.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)
