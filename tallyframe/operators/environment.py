"""Environmental risk: merge two registries, count, score, compare snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import relevance
from tallyframe.functions.classes import found
from tallyframe.functions.keep import js_round


def merge_registries(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All facilities of both registries; fields of b are preferred. Adds source: merged, a or b."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in fields], F.lit(True).alias("ina"))
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in fields], F.lit(True).alias("inb"))
    both = left.join(right, key, "full")
    source = F.when(F.col("ina").isNotNull() & F.col("inb").isNotNull(), "merged").when(F.col("ina").isNotNull(), "a").otherwise("b")
    return both.select(key, *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in fields], source.alias("source"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def snapshot_changes(snapshots: DataFrame, owner: str, at: str, score: str, ids: str, delta: float = 12) -> DataFrame:
    """Each snapshot against the owner's one before: score change, new and gone ids, and whether it is an alert."""
    w = Window.partitionBy(owner).orderBy(at)
    out = snapshots.withColumn("__s", F.lag(score).over(w)).withColumn("__i", F.lag(ids).over(w)).where("__i is not null")
    change = F.col(score) - F.col("__s")
    new, gone = F.array_sort(F.array_except(ids, "__i")), F.array_sort(F.array_except("__i", ids))
    return out.select(owner, at, change.alias("change"), new.alias("new_ids"), gone.alias("gone_ids"), ((F.abs(change) >= delta) | (F.size(new) > 0)).alias("alert"))


def hotspots(rows: DataFrame, dimension: str, key: str, score: str, most: int = 12) -> DataFrame:
    """The highest row of each dimension (ties: least key), the best so many."""
    top = rows.groupBy(dimension).agg(F.max_by(F.struct(key, score), F.struct(F.col(score), -F.col(key))).alias("b"))
    return top.select(dimension, f"b.{key}", f"b.{score}").orderBy(F.desc(score), dimension).limit(most)


def topic_changes(rows: DataFrame, owner: str, year: str, topics: str) -> DataFrame:
    """Topics that a year's report has and the one before had not."""
    before = F.lag(topics).over(Window.partitionBy(owner).orderBy(year))
    return rows.withColumn("__b", before).where("__b is not null").select(owner, year, F.array_sort(F.array_except(topics, "__b")).alias("added"), F.array_sort(F.array_except("__b", topics)).alias("removed"))


# fixed values: points of flags and findings
FLAG_POINTS = {"compliance_serious": 14, "compliance": 5, "enforcement": 12, "emissions": 10, "any_emissions": 8, "waste": 9, "cleanup": 6, "topic": 4, "no_topic": 1.5, "amount": 12, "facility": 2, "permit": 3, "many_flags": 10, "inspected": 2}
SERIOUS, CLEANUP = r"significant|violation|failure|noncompliance", r"superfund|cercla|remediation"


def risk_scores(owners: DataFrame, disclosures: DataFrame, facilities: DataFrame, owner: str = "owner") -> DataFrame:
    """One row per owner with disclosure, compliance, enforcement, emissions, waste, permits and confidence (each 0 to
    100, rounded half up) and overall (from the exact parts).

    owners: owner, errors (failed requests; null: 0). disclosures: owner, topic (other: none), amount, text.
    facilities: owner, arrays compliance, enforcement, emissions and waste of flags (null: none), match (high, medium,
    low, unresolved), inspections (text; "0": none). Sums are taken before owners are joined, so an owner with very
    many rows costs no more than others."""
    p = FLAG_POINTS
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    serious = F.coalesce(F.size(F.filter("compliance", lambda c: found(c, SERIOUS))), F.lit(0))
    vague = F.coalesce(F.col("topic") == "other", F.lit(False))
    d = disclosures.groupBy(owner).agg(
        F.sum(F.when(vague, p["no_topic"]).otherwise(float(p["topic"]))).alias("d_points"), F.max(F.coalesce(F.col("amount").cast("string") != "", F.lit(False))).alias("d_amount"), F.sum(F.when(found(F.col("text"), CLEANUP), p["cleanup"]).otherwise(0)).alias("d_cleanup")
    )
    f = facilities.groupBy(owner).agg(
        F.count("*").alias("n"), F.sum(serious * (p["compliance_serious"] - p["compliance"]) + n("compliance") * p["compliance"]).alias("f_compliance"), F.sum(n("enforcement") * p["enforcement"]).alias("f_enforcement"), F.sum(n("emissions") * p["emissions"]).alias("f_emissions"),
        F.sum(n("waste") * p["waste"]).alias("f_waste"), F.sum(F.when(n("compliance") > 2, p["many_flags"]).otherwise(0) + F.when(F.coalesce("inspections", F.lit("")) != "0", p["inspected"]).otherwise(0)).alias("f_permits"), F.count_if(F.col("match") == "high").alias("high"), F.count_if(F.col("match").isin("low", "unresolved")).alias("low"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    all_ = owners.select(owner, F.coalesce("errors", F.lit(0)).alias("errors")).join(d, owner, "left").join(f, owner, "left")
    parts = {
        "disclosure": clamp(zero("d_points") + F.when(F.col("d_amount"), p["amount"]).otherwise(0)),
        "compliance": clamp(zero("f_compliance") + F.least(F.lit(40.0), zero("n") * p["facility"])),
        "enforcement": clamp(zero("f_enforcement")),
        "emissions": clamp(zero("f_emissions") + F.when(zero("f_emissions") > 0, p["any_emissions"]).otherwise(0)),
        "waste": clamp(zero("f_waste") + zero("d_cleanup")),
        "permits": clamp(zero("n") * p["permit"] + zero("f_permits")),
    }
    confidence = clamp(100 - F.col("errors") * 8 - zero("low") * 3 - F.when(zero("n") == 0, 35).otherwise(0) + zero("high") * 2)
    return all_.select(owner, *[js_round(v).alias(k) for k, v in parts.items()], js_round(confidence).alias("confidence"), relevance.overall_risk(parts, confidence).alias("overall"))
