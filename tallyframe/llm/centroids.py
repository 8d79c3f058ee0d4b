"""Exact integer k-means: each vector's nearest centroid by annulus search over centroids sorted by norm.

|x - c| is at least the difference of the norms of x and c, so a centroid nearer than an upper bound u has a norm within
u of the vector's. Centroids are sorted by norm; two binary searches give each vector the run of centroids in that
annulus, which alone are compared, in exact integers, ties included. The bound is the distance to the vector's centroid of
the round before, or to the centroid next in norm in the first round.

Each round reads the vectors of the round before, writes them with their new centroid, and sums them within tasks; the
driver holds the centroids alone, k times the dimension. Nothing is shuffled by cluster, so hot vectors and hot clusters
cost what others do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch
from tallyframe.session import ship

#: Pairs of vector and candidate compared at once, in one task.
PAIRS = 1 << 16
#: Squared distances of components up to this size, up to 64 of them, fit a long; larger ones take Python integers.
SAFE = 1 << 27
#: Norms are rounded: annuli are wider by this share, so that no candidate on the edge is lost.
SLACK = 1e-6
LONGEST = 2**63 - 1


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) for each component, as integers; x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column, size: int, scale: int = 64) -> Column:
    """Exactly size components, none null, non-finite, or beyond a long once scaled."""
    most = float(2**62 // scale)
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < most))
    return F.coalesce((F.size(vector) == size) & fit, F.lit(False))


def _squared(rows: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)


class Annuli:
    """Centroids sorted by norm. centroids: k rows of integers, numbered from 0."""

    def __init__(self, centroids: list[list[int]]):
        self.wide = max((abs(v) for c in centroids for v in c), default=0) > SAFE
        self.rows = np.array(centroids, dtype=object if self.wide else np.int64)
        norms = np.sqrt(_squared(np.array(centroids, dtype=np.float64)))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each row's nearest centroid (ties: the smaller number), the squared distance, and how many
        pairs were compared. before: each row's centroid of the round before, whose distance is the bound."""
        exact = object if self.wide or (len(x) and np.abs(x).max() > SAFE) or x.shape[1] > 64 else np.int64
        held = self.rows.astype(exact)
        x = x.astype(exact)
        norm = np.sqrt(_squared(x.astype(np.float64)))
        if before is None:
            at = np.searchsorted(self.norms, norm).clip(1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(x), int)
            nearer = np.abs(self.norms[at - 1] - norm) <= np.abs(self.norms[at] - norm)
            before = self.order[np.where(nearer & (at > 0), at - 1, at)]
        bound = np.sqrt(_squared(x - held[before]).astype(np.float64))
        slack = SLACK * (1 + norm + bound)
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        high = np.searchsorted(self.norms, norm + bound + slack, "right")
        best, number = np.zeros(len(x), dtype=exact), np.zeros(len(x), dtype=np.int64)
        counts = high - low
        ends = np.cumsum(counts)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = counts[at:to]
            starts = np.cumsum(n) - n
            row = np.repeat(np.arange(at, to), n)
            found = self.order[np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(low[at:to], n)]
            apart = _squared(x[row] - held[found])
            least = np.minimum.reduceat(apart, starts)
            tied = np.where(apart == np.repeat(least, n), found, len(held))
            best[at:to], number[at:to] = least, np.minimum.reduceat(tied, starts)
            at = to
        return number, best, int(counts.sum())


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(name))
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def assign(df: DataFrame, centroids: list[list[int]], vector: str = "v", cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """Adds or replaces cluster and distance: each row's nearest centroid (ties: the smaller number) and the squared
    distance, null where that is beyond a long. vector holds integers, as many in each row as a centroid has. Where
    df has a column cluster, it is the centroid that bounds the search."""
    ship(df.sparkSession)
    known = cluster in df.columns
    kept = [c for c in df.columns if c not in (cluster, distance)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for b in batches:
            if not len(b):
                continue
            before = b.column(b.schema.get_field_index(cluster)).to_numpy(zero_copy_only=False) if known else None
            number, best, _ = annuli.nearest(_vectors(b, vector), before)
            away = pa.array([None if d > LONGEST else int(d) for d in best], pa.int64()) if best.dtype == object else pa.array(best)
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), away], names=[*kept, cluster, distance])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), f"`{cluster}` int", f"`{distance}` long"])
    return df.mapInArrow(search, schema)


def cluster_sums(df: DataFrame, k: int, vector: str = "v", cluster: str = "cluster") -> dict[int, tuple[int, list[int]]]:
    """For each cluster that has rows: their number and exact componentwise sums. Tasks send k rows of sums at most,
    which are added up by cluster and component; k times the dimension numbers reach the driver."""
    ship(df.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        sums: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            x, number = _vectors(b, vector), b.column(b.schema.get_field_index(cluster)).to_numpy(zero_copy_only=False)
            # sums of halves of 32 bits can't overflow within a batch
            low, high = x & 0xFFFFFFFF, x >> 32
            for c in np.unique(number).tolist():
                mine = number == c
                total = [int(a) + (int(h) << 32) for a, h in zip(low[mine].sum(axis=0), high[mine].sum(axis=0))]
                count[c] = count.get(c, 0) + int(mine.sum())
                sums[c] = [a + t for a, t in zip(sums[c], total)] if c in sums else total
        rows = [(c, count[c], i, s) for c in sums for i, s in enumerate(sums[c])]
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(map(str, v) if t == pa.string() else v, t) for v, t in zip(zip(*rows), kinds)], names=["c", "n", "i", "s"])

    parts = df.select(cluster, vector).mapInArrow(add, "c int, n long, i int, s string")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("c", "i").collect():
        out.setdefault(r.c, (r.n, []))[1].append(int(r.s))
    return out


def first_centroids(df: DataFrame, k: int, seed: int = 1, key: str = "key", vector: str = "v") -> list[list[int]]:
    """The k vectors whose seed and key have the least SHA-256, in that order; equal keys go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256)
    return [list(r.v) for r in df.select(order.alias("o"), F.col(vector).alias("v")).orderBy("o", "v").limit(k).collect()]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """Clusters the rows of df that have a usable vector. Returns a table with key, v (the vector in integers), cluster
    and distance for each such row, and the final centroids.

    Each round assigns every vector to its nearest centroid, then replaces each centroid that has vectors by the
    floor of their mean; after the last round vectors are assigned once more. Null, short, long or non-finite vectors
    are left out; repeated rows and keys stay and count each. A null key stays. With fewer usable vectors than k there
    are as many centroids as vectors. No usable vector: no rows and no centroids. A component beyond 2**62 once scaled
    can't be held in integers and counts as non-finite; a distance beyond a long is null. Other columns of df are not
    read, whatever their names."""
    spark = df.sparkSession
    scratch = Scratch(spark, "centroids")
    kept = df.where(usable(F.col(vector), size, scale)).select(F.col(key).alias("key"), quantized(F.col(vector), scale).alias("v"))
    held = scratch.write(kept, "vectors")
    centroids = first_centroids(held, k, seed)
    if not centroids:
        return held.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}), []
    for _ in range(rounds):
        held = scratch.write(assign(held, centroids), "assigned")
        scratch.drop("vectors")
        for c, (n, sums) in cluster_sums(held, k).items():
            centroids[c] = [s // n for s in sums]
    held = scratch.write(assign(held, centroids), "assigned")
    scratch.drop("vectors")
    return held, centroids
