"""Sinks: CSV, JSON lines, replace by partition, upsert, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.application import upsert


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside fields are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that df has rows of and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert_table(new: DataFrame, old_path: str, new_path: str, keys: list[str], seq: str) -> None:
    """Writes the table at old_path with new's rows merged in to new_path; a reader of old_path isn't disturbed."""
    spark = new.sparkSession
    old = spark.read.parquet(old_path) if _exists(new, old_path) else new.limit(0)
    upsert(old, new, keys, seq).write.mode("overwrite").parquet(new_path)


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


def corpus_bundle(chunks: DataFrame, path: str, key: str) -> None:
    """Chunks and a manifest (counts and a fingerprint of all ids) side by side."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    manifest = stored.agg(F.count("*").alias("n_chunks"), F.countDistinct(key).alias("n_docs"), F.sum(F.xxhash64(F.col(key)).cast("decimal(38,0)")).cast("string").alias("ids"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def limited(df: DataFrame, order: list[str], most: int) -> tuple[DataFrame, bool]:
    """The first rows by order, at most so many, and whether there are more."""
    first = df.orderBy(*order).limit(most + 1)
    return df.orderBy(*order).limit(most), first.count() > most
