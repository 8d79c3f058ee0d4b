"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, UPPER, WHITE, free_names, materialize, other_columns

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z in lower case."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drops lines whose key is in min_docs documents or more, except in the document of the largest id that holds it.

    Returns every column of docs, with text replaced by the lines that stay, and __n_lines (before dropping) and
    __n_dropped. Each row counts as one document; rows that repeat an id and its text lose the same lines. A null id
    is less than any other. Null and empty texts are one empty line and become the empty text. Lines with a key of
    fewer than min_chars code points always stay. Very long texts are read whole; an empty table gives no rows. Columns
    of docs named like the two added are replaced, all others stay, whatever their names.

    Only hashes, ids and positions are shuffled by line; counts are combined before the shuffle, and the join by
    hash has a common line's rows on one side only, which adaptive execution splits. Whole texts move once, by id.
    """
    at, hashed, gone, gone_id, gone_hash = free_names(docs, "__lines", "__text_hash", "__gone", "__gone_id", "__gone_hash")
    lines = docs.withColumn(at, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn(hashed, F.xxhash64(F.col(text)))
    exploded = lines.select(F.col(key).alias("id"), F.col(hashed).alias("text_hash"), F.posexplode(at).alias("pos", "line"))
    keyed = (
        exploded.select("id", "text_hash", "pos", line_key(F.col("line")).alias("k"))
        .where(F.char_length("k") >= min_chars)
        .select("id", "text_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(17), "k").alias("h2"))
    )
    per_doc = lines.select(
        F.col(key).alias("id"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter(F.transform(at, line_key), lambda k: F.char_length(k) >= min_chars),
                    lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(17), k).alias("h2")),
                )
            )
        ).alias("h"),
    )
    frequent = per_doc.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    frequent = materialize(frequent, "line-frequent")  # read anew, so that the join on a very common line can be split
    dropped = (
        keyed.join(frequent, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash))
        .agg(F.collect_set("pos").alias(gone))
    )
    joined = lines.join(dropped, F.col(key).eqNullSafe(F.col(gone_id)) & (F.col(hashed) == F.col(gone_hash)), "left")
    n = F.size(at)
    none = F.array().cast("array<int>")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(gone, none))
    kept = F.when(F.col(gone).isNull(), F.col(at)).otherwise(F.transform(stay, lambda i: F.get(at, i)))
    return joined.select(
        *[F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in other_columns(docs, "__n_lines", "__n_dropped")],
        n.cast("long").alias("__n_lines"),
        F.size(F.coalesce(gone, none)).cast("long").alias("__n_dropped"),
    )
