"""The index of vectors: integrity checks, exact searches against brute force, recall of cells."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import vector_index as vi
from tallyframe.session import new_path

SF = "/root/testdata/sf0.01/embeddings.parquet"


def table(spark, n=600, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of the rows is one vector
    x[5] = 0
    rows = [(i, [float(np.float32(a)) for a in v], "clash") for i, v in enumerate(x)] + [(9001, None, ""), (None, [1.0] * d, ""), (9002, [float("nan")] * d, "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")


def brute(rows, queries, k):
    keys = np.array(sorted(rows))
    m = vi._units(np.array([rows[i] for i in keys], dtype=np.float64))
    out = {}
    for q, v in queries.items():
        cosine = (m @ vi._units(np.array([v], dtype=np.float64))[0]).round(12)
        out[q] = [int(keys[i]) for i in np.lexsort((keys, -cosine))[:k]]
    return out


def told(found):
    out = {}
    for r in found.orderBy("query", F.desc(F.round("cosine", 12)), "key").collect():
        out.setdefault(r.query, []).append(r.key)
    return out


@pytest.mark.parametrize("blocks", [(vi.ROWS, vi.QUERIES), (50, 7)])
def test_exact_search_against_brute_force(spark, blocks):
    df = table(spark)
    path = new_path(spark, "index")
    vi.save_index(df, path, "vec_id", "embedding", cells=6)
    index = vi.load_index(spark, path)
    assert index.rows.count() == 600 and len(index.centroids) == 6
    rows = {r.vec_id: r.embedding for r in df.where("vec_id < 9000").collect()}
    asked = df.where("vec_id % 10 = 0 or vec_id is null or vec_id > 9000").union(df.where("vec_id = 20"))
    found = vi.search(index, asked, 5, "vec_id", "embedding", rows_per_block=blocks[0], queries_per_block=blocks[1])
    assert told(found) == brute(rows, {i: rows[i] for i in rows if i % 10 == 0}, 5)
    assert vi.search(index, asked.limit(0), 5, "vec_id", "embedding").count() == 0


def test_integrity(spark):
    df = table(spark, 60)
    path = new_path(spark, "index")
    vi.save_index(df, path, "vec_id", "embedding", cells=3)
    whole = spark.read.parquet(f"{path}/rows").collect()
    kind = "v array<double>, key long, cell int"
    as_rows = lambda rows: spark.createDataFrame([(r.v, r.key, r.cell) for r in rows], kind)
    for rows, said in ((whole[1:], "rows"), ([*whole, whole[0]], "rows"), ([*whole[1:], whole[1]], "keys"), ([whole[0], *whole[:1], *whole[2:]], "keys")):
        as_rows(rows).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        with pytest.raises(vi.IndexFault, match=said):
            vi.load_index(spark, path)
    changed = [type(whole[0])(v=[9.0] * 8, key=whole[0].key, cell=whole[0].cell), *whole[1:]]
    as_rows(changed).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    with pytest.raises(vi.IndexFault, match="changed"):
        vi.load_index(spark, path)
    assert vi.load_index(spark, path, check=False).rows.count() == 60
    with pytest.raises(vi.IndexFault, match="manifest"):
        vi.load_index(spark, new_path(spark, "nothing"))
    with pytest.raises(vi.IndexFault, match="components"):
        vi.save_index(df.union(spark.createDataFrame([(70, [1.0], "")], df.schema)), new_path(spark, "index"), "vec_id", "embedding")
    with pytest.raises(vi.IndexFault, match="keys"):
        vi.save_index(df.union(df.limit(1)), new_path(spark, "index"), "vec_id", "embedding")
    empty = new_path(spark, "index")
    vi.save_index(df.limit(0), empty, "vec_id", "embedding")
    assert vi.search(vi.load_index(spark, empty), df, 3, "vec_id", "embedding").count() == 0


def test_recall_of_cells(spark):
    df = spark.read.parquet(SF)
    path = new_path(spark, "index")
    vi.save_index(df, path, "vec_id", "embedding", cells=16)
    index = vi.load_index(spark, path)
    exact = vi.search(index, df.where("vec_id % 10 = 0"), 10, "vec_id", "embedding").cache()
    share = vi.recall(vi.search(index, df.where("vec_id % 10 = 0"), 10, "vec_id", "embedding", probes=12), exact)
    assert exact.count() == 500 and share >= 0.9


def test_a_block_takes_the_memory_of_its_rows(monkeypatch):
    """Not that of the cosines of all its queries with all its rows."""
    rng = np.random.default_rng(4)
    part = lambda name, n: pd.DataFrame({name: range(n), "v": list(rng.normal(size=(n, 16)))})
    a, b = part("query", 1000), part("key", 4000)
    tracemalloc.start()
    found = vi._best(a, b, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1000 * 4000 * 8 / 2
    monkeypatch.setattr(vi, "SLICE", 1000)
    whole = vi._best(a, b, 3)
    assert len(found) == 3000 and (found[["query", "key"]] == whole[["query", "key"]]).all(axis=None) and np.allclose(found.cosine, whole.cosine)
