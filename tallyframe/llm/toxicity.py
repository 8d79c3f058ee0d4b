"""Toxicity by a factorization machine over hashed terms.

A score is sigmoid(bias + sum of weights + sum over pairs of terms of the dot product of their factors), so two terms
that are harmless alone (an insulting word, the mention of a group) can weigh together. Terms are the words of a text
and their beginnings. The machine is fitted on a bounded sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, utf8
from tallyframe.session import ship

#: At most so many labelled rows are used to fit (the least hashes of their ids).
MAX_LABELS = 16_000
BITS = 22
BEGINNINGS = (4, 5, 6)
#: Terms that so many fitted rows hold, and whose G-test against the label is at least MIN_G; the best MAX_TERMS.
MIN_ROWS, MIN_G, MAX_TERMS = 3, 12.0, 8192
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 30, 256, 0.1, 1e-4, 3
THRESHOLD = 0.3
_STRIP = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`^"


def term_ids(word: str) -> tuple[int, ...]:
    """Hashes of a word (its punctuation stripped, in lower case) and of its beginnings."""
    w = word.strip(_STRIP)
    if not w:
        return ()
    parts = [f"w{w}", *(f"b{w[:n]}" for n in BEGINNINGS if len(w) >= n)]
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts)


def terms(text: str, seen: dict[str, tuple[int, ...]]) -> set[int]:
    """The distinct term hashes of a text. seen: words met before; emptied when it has grown large."""
    if len(seen) > 200_000:
        seen.clear()
    out: set[int] = set()
    for word in set(text.lower().split()):
        ids = seen.get(word)
        if ids is None:
            ids = seen[word] = term_ids(word)
        out.update(ids)
    return out


@dataclass
class Machine:
    """ids: sorted term hashes; weights and factors by their place in ids."""

    bias: float
    ids: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def places(self, found: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        return at[self.ids[at] == found]

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: the places of each text's terms."""
        out = np.full(len(rows), self.bias)
        for i, r in enumerate(rows):
            if len(r):
                v = self.factors[r]
                s = v.sum(axis=0)
                out[i] += self.weights[r].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def g_test(with_pos: np.ndarray, with_neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The G statistic of term against label."""
    n, out = n_pos + n_neg, np.zeros(len(with_pos))
    for cell, row, column in ((with_pos, with_pos + with_neg, n_pos), (with_neg, with_pos + with_neg, n_neg), (n_pos - with_pos, n - with_pos - with_neg, n_pos), (n_neg - with_neg, n - with_pos - with_neg, n_neg)):
        expected = row * column / n
        out += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1) / np.maximum(expected, 1e-12)), 0)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS, seed: int = SEED, min_g: float = MIN_G) -> Machine:
    """Balanced logistic loss by adaptive gradient steps on batches. rows: the sorted term hashes of each text; labels 0 or 1.
    With one class or no rows only the bias is fitted (with one row of either class added)."""
    y = labels.astype(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    weight = np.where(y == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9))  # both classes weigh the same
    m = Machine(float(np.log(prior / (1 - prior))), np.empty(0, dtype=np.int64), np.empty(0), np.empty((0, factors)))
    if not len(rows) or y.min() == y.max() or not any(map(len, rows)):
        return m
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids, at = np.unique(flat, return_inverse=True)
    pos, all_ = np.bincount(at, weights=y[doc], minlength=len(ids)), np.bincount(at, minlength=len(ids))
    g = g_test(pos, all_ - pos, int(y.sum()), int(len(y) - y.sum()))
    use = np.flatnonzero((all_ >= MIN_ROWS) & (g >= min_g))
    m.ids = np.sort(ids[use[np.argsort(-g[use], kind="stable")[:MAX_TERMS]]])
    rng = np.random.default_rng(seed)
    m.weights, m.factors = np.zeros(len(m.ids)), rng.normal(0, 0.05, (len(m.ids), factors))
    seen = [np.full(1, 1e-3), np.full(len(m.ids), 1e-3), np.full(m.factors.shape, 1e-3)]
    placed = [m.places(r) for r in rows]
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for b in range(0, len(order), BATCH):
            part = order[b : b + BATCH]
            sizes = np.array([len(placed[i]) for i in part])
            idx = np.concatenate([placed[i] for i in part])
            row = np.repeat(np.arange(len(part)), sizes)
            v = m.factors[idx]
            sums = np.stack([np.bincount(row, weights=v[:, k], minlength=len(part)) for k in range(factors)], axis=1)
            squares = np.bincount(row, weights=(v * v).sum(axis=1), minlength=len(part))
            margin = m.bias + np.bincount(row, weights=m.weights[idx], minlength=len(part)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = weight[part] * (sigmoid(margin) - y[part]) / len(part)
            grad_v = error[row][:, None] * (sums[row] - v)
            used, inverse = np.unique(idx, return_inverse=True)
            gw = np.bincount(inverse, weights=error[row], minlength=len(used)) + DECAY * m.weights[used]
            gv = np.stack([np.bincount(inverse, weights=grad_v[:, k], minlength=len(used)) for k in range(factors)], axis=1) + DECAY * m.factors[used]
            gb = error.sum()
            seen[0] += gb * gb
            seen[1][used] += gw * gw
            seen[2][used] += gv * gv
            m.bias -= RATE * gb / np.sqrt(seen[0][0])
            m.weights[used] -= RATE * gw / np.sqrt(seen[1][used])
            m.factors[used] -= RATE * gv / np.sqrt(seen[2][used])
    return m


def telling_terms(rows: DataFrame, min_g: float = MIN_G, most: int = MAX_TERMS) -> DataFrame:
    """term: the terms that at least MIN_ROWS of the rows hold and whose G statistic against the label is at least min_g,
    of these the most telling, at most so many. rows: label, terms (distinct). Counts are summed within tasks first."""
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_pos"))  # one row
    held = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("held"), F.sum("label").alias("pos"))
    t = held.where(F.col("held") >= MIN_ROWS).join(F.broadcast(n))
    neg, rest, n_neg = F.col("held") - F.col("pos"), F.col("n") - F.col("held"), F.col("n") - F.col("n_pos")
    cell = lambda x, row, column: F.when(x > 0, 2 * x * F.log(x * F.col("n") / (row * column))).otherwise(0.0)
    g = cell(F.col("pos"), F.col("held"), F.col("n_pos")) + cell(neg, F.col("held"), n_neg) + cell(F.col("n_pos") - F.col("pos"), rest, F.col("n_pos")) + cell(n_neg - neg, rest, n_neg)
    return t.select("term", g.alias("g")).where(F.col("g") >= min_g).orderBy(F.desc(F.round("g", 6)), "term").limit(most).select("term")


def sample_terms(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELS) -> tuple[list[np.ndarray], np.ndarray]:
    """Telling term hashes and labels of at most so many labelled rows whose texts are in docs. Rows without id or label
    are left out; an id with several labels counts as toxic if one says so, and of several texts the one with the least
    hash is taken. Terms are counted and chosen on the executors; at most MAX_TERMS for each of the bounded sample's rows
    come to the driver."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label is not null")
    chosen = chosen.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(F.col(key).alias("id"), utf8(F.col(text)).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("__id"))
    rows = rows.groupBy("id", "__label").agg(F.min_by("body", F.xxhash64("body")).alias("body"))  # one text for each id

    @F.pandas_udf("array<int>")
    def hashed(s: pd.Series) -> pd.Series:
        seen: dict[str, tuple[int, ...]] = {}
        return s.map(lambda b: np.array(sorted(terms(b.decode("utf-8", "replace"), seen)), dtype=np.int32))

    held = materialize(rows.select("id", F.col("__label").alias("label"), hashed("body").alias("terms")), "toxic-sample")
    held = held.withColumn("row", F.xxhash64("id", "terms"))
    use = F.broadcast(materialize(telling_terms(held), "toxic-terms"))
    told = held.select("row", F.explode(F.array_distinct("terms")).alias("term")).join(use, "term").groupBy("row").agg(F.sort_array(F.collect_set("term")).alias("told"))
    found = held.select("id", "label", "row").join(told, "row", "left").select("id", "label", "told").toPandas().sort_values("id", kind="stable")
    return [np.array(x, dtype=np.int64) if x is not None else np.empty(0, dtype=np.int64) for x in found["told"]], found["label"].to_numpy(dtype=float)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the column score (0 to 1) to docs. Null and empty texts have no terms and get the score of the bias."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # at most MAX_TERMS terms

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        place = {int(x): i for i, x in enumerate(m.ids)}
        seen: dict[str, tuple[int, ...]] = {}

        def places(body: bytes) -> np.ndarray:
            if len(seen) > 200_000:
                seen.clear()
            found: set[int] = set()
            for word in set(body.decode("utf-8", "replace").lower().split()):
                ids = seen.get(word)
                if ids is None:
                    ids = seen[word] = tuple(place[x] for x in term_ids(word) if x in place)
                if ids:
                    found.update(ids)
            return np.array(sorted(found), dtype=np.int64)

        for s in batches:
            yield pd.Series(sigmoid(m.margins([places(b) for b in s])))

    return docs.withColumn(out, scored(utf8(F.col(text))))


def held_out(key: Column) -> Column:
    """True for ids from which no label may be learned."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELS) -> DataFrame:
    """Every row and column of docs with __score, fitted on labels of ids that aren't held out. Every row is scored by its
    own whole text, repeated rows and rows without an id too; null and empty texts get the score of the bias. An empty
    labels table gives one score for all, an empty docs table no rows. A column __score of docs is replaced. Of terms
    with equal statistics those with the lesser hash are used."""
    machine = fit(*sample_terms(docs, labels.where(~held_out(F.col(key))), key, text, label, most))
    return score(docs, machine, text, "__score")
