"""Entity universe: merge layers, score relevance, find gaps, build the role matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import keep, rules, text as tx

# fixed values: ranks of tri-state roles
ROLE_RANK = {"yes": 2, "unclear": 1, "no": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def master_key(entity_id: Column, name: Column, state: Column) -> Column:
    """id:<id> if there is an id, else <name root>|<state>."""
    i = F.trim(F.coalesce(entity_id, F.lit("")))
    return F.when(i != "", F.concat(F.lit("id:"), F.lower(i))).otherwise(F.concat_ws("|", tx.entity_name(name), F.upper(F.trim(F.coalesce(state, F.lit(""))))))


def merge_layers(rows: DataFrame, key: str, layer: str, flags: list[str], sets: list[str], firsts: list[str], score: str) -> DataFrame:
    """One row per key over all layers: flags are true if any is, sets unite, firsts take the first value by layer and
    score the greatest; n_layers counts the layers."""
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(layer, c))).alias(c)
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in flags], *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], *[first(c) for c in firsts], F.max(score).alias(score), F.countDistinct(layer).alias("n_layers"))


def role_matrix(rows: DataFrame, entity: str, role: str, state: str, name: str, doc: str, roles: list[str]) -> DataFrame:
    """One row per entity with the strongest state of each role, the longest name and the number of documents."""
    rank = rules.lookup(F.col(state), {k: float(v) for k, v in ROLE_RANK.items()}, -1.0).cast("int")
    best = [F.max(F.when(F.col(role) == r, rank)).alias(r) for r in roles]
    return rows.groupBy(entity).agg(*best, F.max_by(name, F.struct(F.length(name), name)).alias("display_name"), F.countDistinct(doc).alias("n_docs"))


def role_score(rows: DataFrame, entity: str, role: str, weights: dict[str, float]) -> DataFrame:
    """Sum of the weights of the distinct roles of each entity, at most 100, and its tier."""
    each = rows.groupBy(entity, role).agg(F.lit(1).alias("__one"))
    out = each.groupBy(entity).agg(F.least(F.lit(100.0), F.sum(rules.lookup(F.col(role), weights, 0.0))).alias("score"))
    return out.withColumn("tier", relevance_band(F.col("score")))


def relevance_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").when(score >= 20, "low").otherwise("minimal")


def missing_from(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Rows of left whose normal name isn't in right."""
    names = right.select(tx.entity_name(F.col(right_name)).alias("__n")).where("__n <> ''").distinct()
    return left.withColumn("__n", tx.entity_name(F.col(left_name))).join(names, "__n", "left_anti").drop("__n")


def flag_members(left: DataFrame, right: DataFrame, left_name: str, right_name: str, flag: str) -> DataFrame:
    names = right.select(tx.entity_name(F.col(right_name)).alias("__n")).distinct().withColumn("__in", F.lit(True))
    out = left.withColumn("__n", tx.entity_name(F.col(left_name))).join(names, "__n", "left")
    return out.withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__n", "__in")


def same_root(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: int = 4) -> DataFrame:
    """Rows of left whose name root (of at least so many characters) is the root of a name of right."""
    roots = right.select(tx.entity_root(F.col(right_name)).alias("__r")).where(F.length("__r") >= least).distinct()
    return left.withColumn("__r", tx.entity_root(F.col(left_name))).join(roots, "__r", "left_semi").drop("__r")


def search_tasks(names: DataFrame, name: str, states: list[str], registries: list[str]) -> DataFrame:
    """A task for each distinct name, state and registry. The two lists are short and constant, so tasks are exploded
    from each name; nothing is joined."""
    lists = [F.explode(F.array(*[F.lit(x) for x in values])) for values in (states, registries)]
    out = names.select(F.trim(name).alias("name")).distinct().withColumn("state", lists[0]).withColumn("registry", lists[1])
    return out.withColumn("task_key", F.lower(F.concat_ws("|", "name", "state", "registry")))


def name_variants(name: Column) -> Column:
    """Spellings to search for: the name, without company words, first two words, initials of three or more words."""
    n, root = tx.entity_name(name), tx.entity_root(name)
    words = F.split(root, " ")
    two = F.array_join(F.slice(words, 1, 2), " ")
    initials = F.when(F.size(words) >= 3, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.filter(F.array_distinct(F.array(n, root, two, initials)), lambda v: v.isNotNull() & (v != ""))


def merge_universe(universe: DataFrame, matrix: DataFrame, key: str, force: bool = False) -> DataFrame:
    """universe with rows of matrix: new keys are inserted, confirmed rows stay unless forced, others take the greater
    score and both sets of categories. Both: key, score, categories, confirmed (matrix: null). Adds action."""
    u = universe.select(key, F.col("score").alias("us"), F.col("categories").alias("uc"), F.col("confirmed").alias("cf"), F.lit(True).alias("inu"))
    m = matrix.select(key, F.col("score").alias("ms"), F.col("categories").alias("mc"), F.lit(True).alias("inm"))
    both = u.join(m, key, "full")
    action = F.when(F.col("inm").isNull(), "kept").when(F.col("inu").isNull(), "created").when(F.coalesce("cf", F.lit(False)) & F.lit(not force), "skipped").otherwise("updated")
    both = both.withColumn("action", action)
    none = F.array().cast("array<string>")
    untouched = F.col("action").isin("kept", "skipped")
    score = F.when(untouched, F.col("us")).otherwise(F.greatest("us", "ms"))
    cats = F.when(untouched, F.col("uc")).otherwise(F.array_sort(F.array_union(F.coalesce("uc", none), F.coalesce("mc", none))))
    return both.select(key, score.alias("score"), cats.alias("categories"), F.coalesce("cf", F.lit(False)).alias("confirmed"), "action")


def issues(df: DataFrame, key: str, rules_: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per rule that holds for a row: key, rule, severity. All rules are tried in one pass."""
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, cond in rules_])
    out = df.select(key, F.explode(found).alias("x")).where("x is not null")
    return out.select(key, "x.rule", "x.severity")


def highest_role(members: DataFrame, keys: list[str], role: str, ranks: dict[str, float]) -> DataFrame:
    return keep.keep_last(members, keys, [rules.lookup(F.col(role), ranks, -1.0), F.col(role)])
