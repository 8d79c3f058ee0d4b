"""Near-duplicate groups by MinHash: one-permutation hashing with optimal densification, banded buckets and stars.

Texts with the same set of shingles are one node from the start. Each node's set goes once through one hash; its
least value in each of N_BINS ranges is the signature, and empty ranges copy a filled one found by a fixed probing
sequence. Bands of the signature are buckets. In a bucket every member is a candidate with the bucket's centre only,
the member with the most neighbours, so candidates grow with the members. Candidates whose signatures agree enough
are confirmed on full sets. A bucket that holds several components after that gets further centres, one a round, each
compared with the members of other components. What is open still is compared in tiles of bounded size: first by
signatures alone, which names the few members with a likely partner, then those on full sets, and a tile gives the
links that join components (fewer than its members). So no link is lost because the centres were unlike both of its
ends; the signatures compared in tiles grow with the square of a bucket's members only where a bucket stays open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, likely_rows, materialize, utf8
from tallyframe.session import ship

WORDS = 5
PERCENT = 75
#: 32 bands of 4: a pair at similarity 0.75 shares no bucket with a probability of 5e-6.
N_BINS, ROWS = 128, 4
SEED = 7
#: Pairs in a tile are confirmed if so many of the 128 signature bytes agree; at similarity 0.75 a pair has 96 on average.
LIKELY = 70
#: Centres that an open bucket gets after its first one, before what is left open is compared in tiles.
ROUNDS = 1
#: Members and shingles of one side of a tile at most (a single longer set is a side of its own).
TILE, TILE_SHINGLES = 256, 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


class WordHashes(dict):
    """The 64-bit hash of each word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def shingles(body: bytes, width: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: A to Z lower-cased, words split at ASCII white space. Fewer
    than width words are one shingle; no words give an empty array."""
    words = body.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        return mix(np.array([(w * _odd(len(w), seed)).sum() + np.uint64(len(words))], dtype=np.uint64))
    factors, total = _odd(width, seed), np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total += mix(w[i : i + n] + factors[i]) * factors[i]
    return np.unique(mix(total))


def probe(bins: np.ndarray, attempt: int, n_bins: int = N_BINS) -> np.ndarray:
    return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(n_bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], n_bins: int = N_BINS) -> np.ndarray:
    """One row of n_bins minima for each non-empty set, densified."""
    shift = np.uint64(64 - n_bins.bit_length() + 1)
    out, filled = np.zeros((len(sets), n_bins), dtype=np.uint64), np.zeros((len(sets), n_bins), dtype=bool)
    for row, s in enumerate(sets):
        at = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[row, at[first]] = s[first]
        filled[row, at[first]] = True
    doc, empty = np.nonzero(~filled)
    attempt, values = 1, out.copy()
    while len(doc):
        found = probe(empty, attempt, n_bins)
        hit = filled[doc, found]
        out[doc[hit], empty[hit]] = values[doc[hit], found[hit]]
        doc, empty = doc[~hit], empty[~hit]
        attempt += 1
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket number for each band of each signature; different bands have different buckets."""
    n = signature.shape[1] // rows
    parts = signature.reshape(len(signature), n, rows)
    total = np.broadcast_to(mix(np.arange(1, n + 1, dtype=np.uint64)), (len(signature), n)).copy()
    for i in range(rows):
        total = mix(total ^ parts[:, :, i])
    return total.view(np.int64)


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text_hash, n_shingles, set_hash (128 bits), bands, signature (the low byte of each minimum); no bands for
    empty sets."""
    import xxhash

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                sets = [shingles(b) for b in part["body"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full])
                of = dict(zip(full, zip(bands(sig), sig.astype(np.uint8))))
                yield pd.DataFrame(
                    {
                        "key": part["key"].array,
                        "text_hash": part["text_hash"].array,
                        "n_shingles": [len(s) for s in sets],
                        "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "bands": [of[i][0] if i in of else [] for i in range(len(sets))],
                        "signature": [of[i][1].tobytes() if i in of else b"" for i in range(len(sets))],
                    }
                )

    given = docs.select(F.col(key).cast("string").alias("key"), utf8(F.col(text)).alias("body"), F.xxhash64(utf8(F.col(text))).alias("text_hash"))
    out = given.mapInPandas(rows, "key string, text_hash long, n_shingles long, set_hash binary, bands array<long>, signature binary")
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType))


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"key": part["key"].array, "shingles": [shingles(b).view(np.int64) for b in part["body"]]})

    given = docs.select(F.col(key).cast("string").alias("key"), utf8(F.col(text)).alias("body"))
    return given.mapInPandas(rows, "key string, shingles array<long>").withColumn("key", F.col("key").cast(docs.schema[key].dataType))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common, n = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    sized = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return both.where(sized & (100 * common >= percent * (n - common))).select("a", "b")


def components(edges: DataFrame, made: Scratch | None = None) -> DataFrame:
    """node and root (the least node reachable) for every node of the edges (a, b).

    Each round every node points to its least neighbour if that is less, pointers are followed to their ends by
    doubling, and edges are rewritten between ends; so the number of linked nodes at least halves each round."""
    edges = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    made = made or Scratch(edges.sparkSession, "cc")
    edges, labels = made.write(edges, "edges"), None
    while not edges.isEmpty():
        roots = made.write(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")), "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = made.write(roots.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
            roots = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = made.write(roots, "labels")
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            labels = made.write(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        ends = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"}
        edges = made.write(edges.join(ends["a"], "a").join(ends["b"], "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def tiled(members: DataFrame, written: Callable[[DataFrame, str], DataFrame] = materialize, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """The rows of members, once for each tile they take part in. members: bucket, rep, n_shingles, root, ...

    Only buckets with several roots get tiles. The members of a bucket's largest root are compared with its other
    members (kind 0), and those among themselves (kind 1); both sides are split into blocks of bounded rows and
    shingles, and each pair of blocks is one tile."""
    per_root = members.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    stats = per_root.groupBy("bucket").agg(
        F.max_by(F.struct("root", "c", "s"), F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s")
    ).where("c > top.c")
    blocks = lambda c, s: F.greatest(F.lit(1), F.ceil(c / tile), F.ceil(s / tile_shingles)).cast("int")
    stats = stats.select("bucket", F.col("top.root").alias("top"), blocks(F.col("top.c"), F.col("top.s")).alias("n_top"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("n_rest"))
    rows = members.join(written(stats, "tiles"), "bucket").withColumn("is_top", F.col("root") == F.col("top"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    at = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.xxhash64("bucket", F.lit(kind), x, y).alias("tile"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    ours = F.transform(upto("n_rest"), lambda o: at(0, F.col("block"), o))
    others = F.concat(F.transform(upto("n_top"), lambda o: at(0, o, F.col("block"))), F.transform(upto("n_rest"), lambda o: at(1, F.least(F.col("block"), o), F.greatest(F.col("block"), o))))
    rows = rows.withColumn("block", block).withColumn("__at", F.explode(F.when(F.col("is_top"), ours).otherwise(others)))
    return rows.select(*members.columns, "is_top", "__at.kind", "__at.tile")


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def tile_pairs(g: pd.DataFrame, percent: int = PERCENT, likely: int = LIKELY) -> list[tuple[int, int, int]]:
    """(-agreement, i, j) of the rows of one tile with different roots whose sizes allow a link and whose signatures
    agree in likely bytes."""
    sig = np.frombuffer(b"".join(g["signature"]), dtype=np.uint8).reshape(len(g), -1)
    n, top, kind, codes = g["n_shingles"].to_numpy(), g["is_top"].to_numpy(), g["kind"].to_numpy(), pd.factorize(g["root"])[0]
    found: list[tuple[int, int, int]] = []
    for i in range(len(g) - 1):
        ok = (codes[i + 1 :] != codes[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
        if kind[i] == 0:
            ok &= top[i + 1 :] != top[i]
        k = np.flatnonzero(ok) + i + 1
        agree = (sig[k] == sig[i]).sum(axis=1)
        found += [(-int(a), i, int(x)) for a, x in zip(agree[agree >= likely], k[agree >= likely])]
    return found


def tile_members(g: pd.DataFrame, percent: int = PERCENT, likely: int = LIKELY) -> list[tuple[int, int]]:
    """bucket and rep of the rows of one tile that take part in a likely pair; a pair counts in the first bucket that it
    shares only."""
    rep, bucket, bands_ = g["rep"].to_numpy(), int(g["bucket"].iloc[0]), np.array(g["bands"].tolist(), dtype=np.int64)
    pairs = np.array([(i, j) for _, i, j in tile_pairs(g, percent, likely)], dtype=np.int64).reshape(-1, 2)
    same = bands_[pairs[:, 0]] == bands_[pairs[:, 1]]
    first = bands_[pairs[:, 0], same.argmax(axis=1)] if len(pairs) else np.empty(0, dtype=np.int64)
    return [(bucket, int(x)) for x in np.unique(rep[pairs[first == bucket]])]


def tile_links(g: pd.DataFrame, percent: int = PERCENT, likely: int = LIKELY) -> list[tuple[int, int]]:
    """Confirmed links of one tile that join what wasn't joined, at most one less than its rows: likely pairs are
    confirmed on full sets, the most similar first."""
    forest, first_of = Forest(len(g)), {}
    for i, c in enumerate(pd.factorize(g["root"])[0].tolist()):
        forest.join(first_of.setdefault(c, i), i)
    n, rep, sets, out = g["n_shingles"].to_numpy(), g["rep"].to_numpy(), g["shingles"].to_numpy(), []
    for _, i, j in sorted(tile_pairs(g, percent, likely)):
        if forest.root(i) != forest.root(j):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (n[i] + n[j] - common):
                forest.join(i, j)
                out.append((int(rep[i]), int(rep[j])))
    return out


def by_tile(rows: DataFrame, of: Callable[[pd.DataFrame], list[tuple]], columns: list[str]) -> DataFrame:
    """What of() gives for each tile; tiles are bounded, and a partition's tiles pass one after the other."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            t = batch["tile"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1]) if len(t) else np.zeros(1, dtype=int)
            held = batch.iloc[starts[-1] :]
            found = [p for a, b in zip(starts, starts[1:]) if b - a > 1 for p in of(batch.iloc[a:b])]
            yield pd.DataFrame(found, columns=columns, dtype="int64")
        if held is not None and len(held) > 1:
            yield pd.DataFrame(of(held), columns=columns, dtype="int64")

    return rows.repartition("tile").sortWithinPartitions("tile").mapInPandas(each, ", ".join(f"{c} long" for c in columns))


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT, likely: int = LIKELY) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose signatures agree in likely bytes."""

    @F.pandas_udf("int")
    def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).sum(axis=1), dtype="int32")

    left, right = (nodes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("signature").alias(f"g{c}")) for c in "ab")
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(left, "a").join(right, "b").where(sized).where(agreeing("ga", "gb") >= likely).select("a", "b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id (the least id reachable by links) and kept (key = component_id), for each row.

    Null and empty texts and texts of white space have no shingles: they are linked with nothing and kept. Rows
    without an id are linked with nothing, have a null component_id and are kept. A node is a set of shingles, named
    by a 64-bit hash of it, so texts that share an id are linked each by its own words. Empty tables give no rows;
    other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    made = Scratch(docs.sparkSession, "near")
    signed = made.write(sign(docs, key, text), "signatures")
    with_set = signed.where("n_shingles > 0 and key is not null")
    nodes = with_set.groupBy("set_hash").agg(F.min(F.struct("key", "text_hash")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = made.write(nodes.select(F.xxhash64("set_hash").alias("rep"), "set_hash", F.col("of.key").alias("least"), F.col("of.text_hash").alias("text_hash"), "n_shingles", "bands", "signature"), "nodes")
    signed = made.write(signed.select("key", "n_shingles", "set_hash"), "rows")  # signatures and bands are in nodes from here on
    made.drop("signatures")
    placed = nodes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = made.write(placed.join(made.write(shared, "shared"), "bucket"), "members")
    made.drop("shared")
    # the centre of a bucket is the member with the most neighbours in all its buckets: an original among its copies
    scores = made.write(members.groupBy("rep").agg(F.sum("n").alias("score")), "scores")
    scored = made.write(members.join(scores, "rep").select("bucket", "rep", "n_shingles", "score"), "scored")
    made.drop("members", "scores")
    centers = made.write(scored.groupBy("bucket").agg(F.max_by("rep", F.struct("score", "rep")).alias("center")), "centers")
    stars = scored.join(centers, "bucket").where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = made.write(likely_pairs(stars, nodes, percent), "pairs")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(utf8(F.col(text))).alias("text_hash"))

    def sets_of(reps: DataFrame, step: str) -> DataFrame:
        """The shingles of nodes, from the text of a node's least id; of rows that repeat both any will do."""
        wanted = nodes.join(reps.distinct(), "rep", "left_semi").select("rep", F.col("least").alias("wanted"), F.col("text_hash").alias("wanted_hash"))
        wanted = made.write(wanted, "wanted")
        of_node = likely_rows(texts, "text_hash", wanted, "wanted_hash").join(wanted, (F.col("key") == F.col("wanted")) & (F.col("text_hash") == F.col("wanted_hash")))
        return made.write(shingle_sets(of_node, "rep", "text").where(F.size("shingles") > 0).dropDuplicates(["key"]), step)

    sets = sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), "sets")
    links = made.write(confirm(pairs, sets, percent), "links")
    labels = components(links, made)
    used = centers.select("bucket", "center")
    for k in range(ROUNDS):  # buckets with several components get another centre each round
        opened = open_members(scored, labels)
        if opened.isEmpty():
            break
        opened = made.write(opened, f"open-{k}")
        made.drop(f"open-{k - 1}")
        roots = opened.join(used, (opened["bucket"] == used["bucket"]) & (opened["rep"] == used["center"]), "left_semi").select("bucket", "root")
        fresh = opened.join(roots.distinct(), ["bucket", "root"], "left_anti")
        per_root = fresh.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.max_by("rep", F.struct("score", "rep")).alias("top"))
        new = made.write(per_root.groupBy("bucket").agg(F.max_by(F.struct("top", "root"), F.struct("c", "top")).alias("best")).select("bucket", F.col("best.top").alias("center"), F.col("best.root").alias("center_root")), f"new-{k}")
        stars = opened.join(new, "bucket").where("root <> center_root").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
        pairs = made.write(likely_pairs(stars, nodes, percent), "pairs")
        used = used.union(new.select("bucket", "center"))
        if not pairs.isEmpty():
            more = sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), f"sets-{k}")
            links = links.union(made.write(confirm(pairs, more, percent), f"links-{k}"))
            made.drop(f"sets-{k}")
            labels = components(links, made)
    made.drop("sets", "pairs")
    # what is open still: pairs of blocks of bounded size, first by signatures alone
    opened = open_members(scored, labels)
    if not opened.isEmpty():
        opened = made.write(opened.select("bucket", "rep", "n_shingles", "root"), "open")
        rows = tiled(opened, made.write).join(nodes.select("rep", "signature", "bands"), "rep")
        told = made.write(by_tile(rows, lambda g: tile_members(g, percent), ["bucket", "rep"]).distinct(), "told")
        if not told.isEmpty():
            sets = sets_of(told.select("rep"), "sets").withColumnRenamed("key", "rep")
            rows = tiled(opened.join(told, ["bucket", "rep"], "left_semi"), made.write).join(nodes.select("rep", "signature"), "rep").join(sets, "rep")
            links = links.union(made.write(by_tile(rows, lambda g: tile_links(g, percent), ["a", "b"]), "links-open"))
            labels = components(links, made)
    made.drop("sets", "open", "told", "tiles", "scored", "wanted", "centers")
    ids = nodes.select(F.col("rep").alias("node"), "least")
    least = made.write(labels.join(ids, "node").groupBy("root").agg(F.min("least").alias("component")), "least")
    named = labels.join(least, "root").select(F.col("node").alias("rep"), "component")
    # written, so that the join on a text with very many copies can be split
    roots = made.write(nodes.join(named, "rep", "left").select(F.col("set_hash").alias("of"), F.coalesce("component", "least").alias("root")), "roots")
    made.drop("nodes", "labels", "least", *[x for x in made.paths if x.startswith(("links", "open", "new"))])
    out = signed.join(roots, (F.col("set_hash") == F.col("of")) & F.col("key").isNotNull(), "left")
    component = F.coalesce("root", "key")
    return out.select("key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def open_members(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets with several roots, with their roots."""
    rooted = scored.join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n_shingles", "score", F.coalesce("root", "rep").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    return rooted.join(several, "bucket", "left_semi")
