"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import Scratch, materialize, new_path, shared_dir  # noqa: F401  (used by the operators)

#: The ASCII white space of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that df has as columns (in any case), for columns used in between."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def other_columns(df: DataFrame, *made: str) -> list[str]:
    """The columns of df but those that an operator makes anew."""
    return [c for c in df.columns if c.lower() not in made]


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A bitmap has at most so many bits (16 MB), and so many for each hash up to that.
MOST_BITS, BITS_EACH = 1 << 27, 16
_PART = 1 << 15


def likely_rows(df: DataFrame, hash_: str, wanted: DataFrame, wanted_hash: str) -> DataFrame:
    """The rows of df whose 64-bit hash may be among wanted's, so that a join that keeps few rows needn't shuffle all.

    Hashes are tested against a bitmap of bounded size, one bit for each; a sixteenth of the other rows passes too, more
    where wanted has over 8 million rows, and all where the bitmap would be half full. The exact join must follow."""
    n = wanted.count()
    bits = min(MOST_BITS, 1 << max(15, (BITS_EACH * n).bit_length()))
    if 2 * n > bits:
        return df
    place = F.pmod(F.col(wanted_hash), F.lit(bits))
    parts = wanted.select(F.floor(place / _PART).alias("part"), (place % _PART).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.collect():  # at most 4,096 rows of 4 KB
        held[r.part * _PART // 8 : (r.part + 1) * _PART // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    told = df.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        at = h.to_numpy(dtype=np.int64) % bits
        return pd.Series((told.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return df.where(F.col(hash_).isNotNull()).where(may(F.col(hash_)))
