"""An index of vectors as a partitioned table with a manifest, and searches whose queries are a table.

Rows are kept by the nearest of some centroids (a cell), which are fitted on a bounded sample; every row is indexed.
A search deals (queries of a cell, rows of a cell) out in blocks of bounded size, so a cell with a third of all rows is
split, and neither side is ever gathered. Exact searches take all cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import ship

#: Rows that centroids are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Rows and queries in one block at most, about.
ROWS, QUERIES = 16_384, 1_024
#: Queries of a block whose cosines with all its rows are in memory at once.
SLICE = 64
_SALTS = 64


class IndexFault(ValueError):
    """An index that isn't what its manifest says."""


def _units(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _clean(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    whole = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(key).alias("key"), v.alias("v"))


def fit_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most so many rows of vectors (key, v), those with the least hashes of their keys, by
    spherical k-means; the same table gives the same centroids."""
    rows = [r.v for r in vectors.orderBy(F.xxhash64("key"), "key").limit(sample).collect()]  # bounded
    x = _units(np.array(rows, dtype=np.float64))
    out = x[: max(1, min(cells, len(x)))].copy()
    for _ in range(rounds):
        near = (x @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 0
        out[full] = _units(sums[full])
    return out


def _nearest(centroids: np.ndarray, n: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = b.column(b.schema.get_field_index("v"))
                cosine = _units(v.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)) @ centroids.T
                cells = np.argsort(-cosine, axis=1, kind="stable")[:, :n].astype(np.int32)
                offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * cells.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], names=[*b.schema.names, "cells"])

    return near


def _with_cells(df: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_nearest(centroids, n), f"{kinds}, cells array<int>")


def save_index(vectors: DataFrame, path: str, key: str, embedding: str, cells: int = 64) -> None:
    """Writes vectors as an index under path: rows by cell, centroids, and a manifest (rows, sum of key hashes,
    dimension). Rows with a null key, a null vector or a component that isn't finite are left out. Keys must be unique
    and vectors of one length, else IndexFault; a faulty table leaves no manifest. An empty table makes an empty index."""
    spark = vectors.sparkSession
    ship(spark)
    clean = _clean(vectors, key, embedding)
    sizes = clean.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes.least != sizes.most or sizes.least == 0:
        raise IndexFault(f"vectors have {sizes.least} to {sizes.most} components")
    centroids = fit_centroids(clean, cells) if sizes.least else np.zeros((1, 1))
    rows = _with_cells(clean, centroids, 1).select("key", "v", F.get("cells", F.lit(0)).alias("cell")) if sizes.least else clean.withColumn("cell", F.lit(0))
    rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    told = _facts(spark.read.schema("key " + clean.schema["key"].dataType.simpleString() + ", v array<double>, cell int").parquet(f"{path}/rows"))
    if told["rows"] != told["keys"]:
        raise IndexFault(f"{told['rows']} rows have {told['keys']} keys")
    manifest = {"rows": told["rows"], "digest": told["digest"], "dimension": sizes.least or 0, "key": clean.schema["key"].dataType.simpleString(), "cells": len(centroids)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _facts(rows: DataFrame) -> dict:
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "v").cast("decimal(38,0)")).alias("h"))
    got = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest")).first()
    return got.asDict()


class Index:
    """A loaded index: rows (key, v, cell), centroids, dimension."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, dimension: int):
        self.rows, self.centroids, self.dimension = rows, centroids, dimension


def load_index(spark: SparkSession, path: str, check: bool = True) -> Index:
    """The index under path. Checked against its manifest: number of rows, unique keys, the same keys and vectors, one
    dimension, all centroids; what differs raises IndexFault, as does an index without a manifest. check=False tests
    the centroids only."""
    ship(spark)
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        raise IndexFault(f"no manifest under {path}") from e
    rows = spark.read.schema(f"key {manifest['key']}, v array<double>, cell int").parquet(f"{path}/rows")
    centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    if len(centroids) != manifest["cells"]:
        raise IndexFault(f"{len(centroids)} centroids where {manifest['cells']} are due")
    if check:
        got = _facts(rows)
        if got["rows"] != manifest["rows"] or got["keys"] != manifest["rows"]:
            raise IndexFault(f"{got['rows']} rows with {got['keys']} keys where {manifest['rows']} are due")
        if got["digest"] != manifest["digest"]:
            raise IndexFault("keys or vectors have changed since the index was saved")
        if not rows.where(F.size("v") != manifest["dimension"]).isEmpty():
            raise IndexFault("a vector has another length")
    return Index(rows, centroids, manifest["dimension"])


def _best(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, key, cosine of the k rows of a block (b: key, v) most like each query of a block (a: query, v)."""
    if not len(a) or not len(b):
        return pd.DataFrame({"query": a["query"][:0], "key": b["key"][:0], "cosine": np.zeros(0)})
    b = b.sort_values("key", kind="stable")
    x, y = _units(np.stack(a["v"].to_numpy())), _units(np.stack(b["v"].to_numpy())).T
    order, near = [], []
    for i in range(0, len(x), SLICE):
        cosine = x[i : i + SLICE] @ y
        order.append(np.argsort(-cosine.round(12), axis=1, kind="stable")[:, :k].copy())  # the slice would hold the whole
        near.append(np.take_along_axis(cosine, order[-1], axis=1))
    order, near = np.concatenate(order), np.concatenate(near)
    return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), order.shape[1]), "key": b["key"].to_numpy()[order.ravel()], "cosine": near.ravel()})


def search(index: Index, queries: DataFrame, k: int, key: str, embedding: str, probes: int | None = None, rows_per_block: int = ROWS, queries_per_block: int = QUERIES) -> DataFrame:
    """query, key and cosine of the k rows most like each query (ties: the least key; cosines are compared to 12
    places; a zero vector has 0). probes: cells looked into for each query, the nearest first; None looks into all and
    is exact. Queries with a null key, a null vector, another length or a component that isn't finite give no rows; of
    repeated keys one stands. Other columns are not read.

    Each cell is dealt into blocks of rows and of queries by hashes of their keys, each pair of blocks is one group."""
    spark = queries.sparkSession
    ship(spark)
    asked = _clean(queries, key, embedding).where(F.size("v") == index.dimension).groupBy("key").agg(F.min("v").alias("v")).withColumnRenamed("key", "query")
    n_cells = len(index.centroids)
    asked = _with_cells(asked, index.centroids, min(probes or n_cells, n_cells)).select("query", "v", F.explode("cells").alias("cell"))
    size = lambda df, name, most: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = size(index.rows, "row_blocks", rows_per_block).join(size(asked, "query_blocks", queries_per_block), "cell")  # one row per cell
    blocks = F.broadcast(blocks)
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "cell").select("cell", of("query", "query_blocks").alias("q"), upto("row_blocks").alias("r"), "query", "v")
    right = index.rows.join(blocks, "cell").select("cell", upto("query_blocks").alias("q"), of("key", "row_blocks").alias("r"), "key", "v")
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    group = ["cell", "q", "r"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(lambda a, b: _best(a, b, k), f"query {kind(asked, 'query')}, key {kind(index.rows, 'key')}, cosine double")
    row = F.struct((-F.round("cosine", 12)).alias("far"), "key", "cosine")
    cut = lambda rows: F.slice(F.array_sort(F.flatten(F.collect_list(rows))), 1, k)
    salted = found.groupBy("query", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("best"))
    return salted.groupBy("query").agg(cut(F.col("best")).alias("best")).select("query", F.explode("best").alias("b")).select("query", "b.key", "b.cosine")


def recall(found: DataFrame, exact: DataFrame) -> Column | float:
    """The share of the exact answers (query, key) that were found."""
    hit = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left").agg((F.count("hit") / F.count("*")).alias("share"))
    return float(hit.first().share or 0.0)
