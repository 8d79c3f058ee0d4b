"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyframe.llm import line_dedup, mixing, near_dedup, packing, quality
from tallyframe.llm.common import documents, free_names, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without words (null and empty texts) among them; the others stay
    as they are, repeated rows each."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.quality(docs, trusted).where("__kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all texts but one; every row stays, with n_chars of what is left. A null text becomes empty."""
    out = line_dedup.dedup_lines(docs).drop("__n_lines", "__n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def row_key(docs: DataFrame) -> Column:
    """A name for each row, ordered by id (rows without one last), then by hashes of the text and the other columns.
    Only rows that are equal in all columns share one; without its last 16 characters it names the id and the text."""
    hex16 = lambda c: F.lpad(F.hex(c), 16, "0")
    own = F.col("doc_id").cast("string")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        shifted = F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        own = F.lpad(shifted.cast("string"), 20, "0")  # signed numbers in the order of their digits
    rest = F.to_json(F.struct(F.lit(0).alias("0"), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    named = F.coalesce(F.concat(F.lit("0"), own), F.lit("1"))
    return F.concat(named, F.lit("\0"), hex16(F.xxhash64("text")), hex16(F.xxhash64(F.lit(1), "text")), hex16(F.xxhash64(rest)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the first by row_key: that of the least id, rows without an id last.
    Texts are compared one by one, whatever ids they have. Of texts without words one of each id and text stays."""
    row, kept_row = free_names(docs, "__row", "__kept_row")
    rows = docs.withColumn(row, row_key(docs))
    kept = near_dedup.near_groups(rows, row).where("kept").groupBy(F.expr("left(key, length(key) - 16)")).agg(F.min("key").alias(kept_row))
    kept = materialize(kept.select(kept_row), "near-kept")
    one = rows.join(kept, F.col(row) == F.col(kept_row), "left_semi").dropDuplicates([row])
    return one.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stays as often as the mix takes it, at most three times; rows that it doesn't take go, those without
    words among them. Rows are chosen by row_key, so reruns agree. Equal rows are rows of their own: their class stays
    as often as the mix takes all of them, made from one of them."""
    key, taken_key, times, n, copy, block = free_names(docs, "__key", "__taken_key", "__times", "__n", "__copy", "__block")
    keyed = docs.withColumn(key, row_key(docs))
    sized = keyed.select(key, F.size(quality.words_of(F.col("text"))).cast("long").alias("size"), F.array("source").alias("members"))
    share = F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("long")
    taken = mixing.mix(sized, key=key).groupBy(F.col("key").alias(taken_key)).agg(share.alias(times), F.count("*").alias(n))
    taken = materialize(taken.where(F.col(times) > 0), "mix-taken")  # read anew, so that joins see its size
    single = keyed.join(taken.where(F.col(n) == 1), F.col(key) == F.col(taken_key))
    single = single.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
    # a class may be very large: one of its rows is dealt out in blocks before it is copied
    equal = keyed.join(taken.where(F.col(n) > 1), F.col(key) == F.col(taken_key)).dropDuplicates([key])
    blocks = equal.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / 1000)))).repartition(F.col(key), F.col(block))
    copies = F.least(F.lit(1000), F.col(times) - 1000 * F.col(block)).cast("int")
    return single.unionByName(blocks.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of at most 2048: one row per piece. Null and empty texts are one piece of one id;
    the pieces of repeated rows are pieces of their own."""
    pieces = packing.tokenize(docs)
    out = packing.pack(pieces.select("key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return out.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: Hashed ratios, seeded choices and packing can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
