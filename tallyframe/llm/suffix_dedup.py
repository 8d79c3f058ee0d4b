"""Exact removal of repeated passages by suffix arrays.

A byte is removed if a string of LENGTH bytes over it also starts elsewhere. Comparing every shard of the corpus with
every other would grow with the square of the input, so windows that may be equal are first brought into the same
shard: each window of LENGTH bytes has an anchor, the least hash of its GRAM-byte strings, and equal windows have
equal anchors. Runs of windows with one anchor are contexts. Anchors found only once need no more work; an anchor whose
contexts are all the same has only repeated windows (anchor and digest are 128 bits of hash over the same bytes, so
copies are told apart from look-alikes as safely as by any digest). What is left, one copy of each distinct context,
goes into shards of bounded size. Each shard sorts its suffixes by Larsson-Sadakane refinement and takes common prefixes by
Kasai's rule; neighbours that agree in LENGTH bytes are repeats. An anchor with too many contexts for one shard is
dealt over several. Each of them gives a sorted run of the digests of its distinct windows, cut by digest into buckets
of bounded size, and the runs of a bucket are merged by binary search.

The same work runs over units of a byte or of a word (a 32-bit hash), so passages can be measured in bytes or words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, utf8
from tallyframe.llm.near_dedup import _words, mix
from tallyframe.session import ship

LENGTH = 400
GRAM = 100
#: Passages in words: so many in a row, with anchors of so many.
WORDS, WORD_GRAM = 51, 12
SHARD_BYTES = 1 << 20
#: An anchor with more bytes of contexts than this is dealt over several shards.
HOT_BYTES = 1 << 19
#: Bytes of contexts whose windows are merged in one bucket (about 12 times as many bytes of digests and places).
BUCKET_BYTES = 1 << 22
RUN = 2048
BLOCK = 1 << 20

_R = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_R ** i and its inverse modulo 2^64, for i up to n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_R, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_R, inverse)]
    return _powers[0], _powers[1]


def units(body: bytes, width: int) -> np.ndarray:
    """The units of a body: bytes (width 1) or 32-bit word hashes (width 4)."""
    return np.frombuffer(body, dtype=np.uint8 if width == 1 else "<u4")


def word_codes(body: bytes) -> bytes:
    """A text as one 32-bit hash for each of its words, in order; words end at ASCII white space."""
    return np.fromiter(map(_words.__getitem__, body.split()), dtype=np.uint64).astype("<u4").tobytes()


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram units that start at each place."""
    power, inverse = _power(len(b) + 1)
    value = _BYTE[b] if b.dtype == np.uint8 else mix(b.astype(np.uint64) + np.uint64(_R))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * power[: len(b)], dtype=np.uint64)])
    n = len(b) - gram + 1
    return mix((sums[gram : gram + n] - sums[:n]) * inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_twice(hashes: np.ndarray, least: np.ndarray, anchors: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, span: int) -> np.ndarray:
    """For each run of windows whether its anchor starts at two places or more inside it, so that it may repeat itself.
    least: the anchor of each window, 0 for those that don't count."""
    around = np.concatenate([np.zeros(span, dtype=np.uint64), least, np.zeros(span, dtype=np.uint64)])
    places = np.flatnonzero(~sliding_min(~around, span + 1)[: len(hashes)] == hashes)  # the anchors of some window
    values, code = np.unique(hashes[places], return_inverse=True)
    at = np.sort(code * len(hashes) + places)
    own = np.searchsorted(values, anchors) * len(hashes)
    return np.searchsorted(at, own + lasts + span, side="right") - np.searchsorted(at, own + firsts) > 1


def contexts_of(bodies: list[bytes], length: int = LENGTH, gram: int = GRAM, width: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor, for several texts at once: the number of the text (ascending), anchor,
    digest of the bytes of the run's windows, first and last start (in units), and 1 if the anchor is found twice."""
    import xxhash

    found: list[list[np.ndarray]] = [[], [], [], [], [], []]

    def runs(group: list[tuple[int, int, np.ndarray]]) -> None:
        b = np.concatenate([x for _, _, x in group])
        sizes = np.array([len(x) for _, _, x in group])
        base, n = np.cumsum(sizes) - sizes, sizes - length + 1
        piece = np.repeat(np.arange(len(group)), n)
        at = np.arange(n.sum()) + np.repeat(base - (np.cumsum(n) - n), n)  # the windows that lie in one text
        hashes = gram_hashes(b, gram)
        every = sliding_min(hashes, length - gram + 1)
        least = np.zeros(len(every), dtype=np.uint64)
        least[at] = every[at]
        own = every[at]
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])]))
        ends = np.append(starts[1:], len(at))
        if (ends - starts).max() > RUN:
            cuts = [np.arange(s, e, RUN) for s, e in zip(starts.tolist(), ends.tolist())]
            starts = np.concatenate(cuts)
            ends = np.append(starts[1:], len(at))
        first, last, view = at[starts], at[ends - 1], memoryview(b).cast("B")
        digest = np.array([xxhash.xxh3_64_intdigest(view[s * width : (e + length) * width]) for s, e in zip(first.tolist(), last.tolist())], dtype=np.uint64)
        of = piece[starts]
        text, offset = (np.array([g[i] for g in group])[of] for i in (0, 1))
        twice = anchored_twice(hashes, least, own[starts], first, last, length - gram)
        shift = offset - base[of]
        for kept, x in zip(found, (text, own[starts].view(np.int64), digest.view(np.int64), first + shift, last + shift, twice)):
            kept.append(x.astype(np.int64))

    group: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for i, body in enumerate(bodies):
        whole = units(body, width)
        for at in range(0, len(whole) - length + 1, BLOCK):
            group.append((i, at, whole[at : at + BLOCK + length - 1]))
            held += len(group[-1][2])
            if held > BLOCK:
                runs(group)
                group, held = [], 0
    if group:
        runs(group)
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in found)


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each unit on as one number; zeros follow the end."""
    per = 8 // data.itemsize
    padded = np.concatenate([data, np.zeros(per, dtype=data.dtype)])
    key = np.zeros(len(data), dtype=np.uint64)
    for i in range(per):
        key = (key << np.uint64(64 // per)) | padded[i : i + len(data)]
    return key


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data in order, and the rank of each place, by Larsson-Sadakane refinement: suffixes are sorted
    by 8 bytes, then groups not yet sorted by the group of the suffix as many places on, which doubles each time."""
    n, per = len(data), 8 // data.itemsize
    key = _eight(data)
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]]) if n else np.empty(0, dtype=bool)
    # zero padding is like zero units; the shorter of two suffixes that agree to the end comes first
    short = np.flatnonzero(sa > n - per)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = group
    if len(short):
        ends = group[short]
        for g in np.unique(ends):
            stop = np.searchsorted(group, g, side="right")
            own = sa[g:stop]
            own = own[np.lexsort((own, np.where(own > n - per, n - own, per)))]
            sa[g:stop] = own
            sizes = np.where(own > n - per, n - own, per)
            rank[own] = g + np.concatenate([[0], np.maximum.accumulate(np.where(sizes[1:] != sizes[:-1], np.arange(1, len(own)), 0))])
    h = per
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank[sa]] > 1) if n else np.empty(0, dtype=np.int64)
    while len(open_):
        places = sa[open_]
        on = places + h
        second = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        first = rank[places]
        order = np.argsort(first * (n + 1) + second, kind="stable")
        places, first, second = places[order], first[order], second[order]
        sa[open_] = places
        change = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        start = np.maximum.accumulate(np.where(change, np.arange(len(open_)), 0))
        rank[places] = open_[start]
        size = np.bincount(start, minlength=len(open_))[start]
        open_ = open_[size > 1]
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place of sa, the common prefix with the suffix before it (0 for the first).

    By Kasai's rule a place whose left neighbour equals the left neighbour of its predecessor has one less than the
    place before; so only the other places are compared, all of them at once, eight bytes a step."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    i = np.arange(n)
    follows = (i > 0) & (before > 0)
    follows &= data[np.maximum(i - 1, 0)] == data[np.maximum(before - 1, 0)]
    heads = np.flatnonzero(~follows)
    per = 8 // data.itemsize
    word = np.append(_eight(data), np.uint64(0))
    most = np.where(before[heads] < 0, 0, n - np.maximum(heads, before[heads]))
    got, alive = np.zeros(len(heads), dtype=np.int64), np.flatnonzero(most > 0)
    while len(alive):
        a, b = heads[alive] + got[alive], before[heads[alive]] + got[alive]
        differ = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        same = np.full(len(alive), per)
        some = differ != 0
        # the number of leading units that are zero
        d = differ[some]
        same[some] = sum((d < (np.uint64(1) << np.uint64(64 - 64 // per * k))).astype(np.int64) for k in range(1, per))
        got[alive] = np.minimum(got[alive] + same, most[alive])
        alive = alive[(same == per) & (got[alive] < most[alive])]
    head = np.maximum.accumulate(np.where(follows, 0, i))
    value = np.zeros(n, dtype=np.int64)
    value[heads] = got
    return np.maximum(value[head] - (i - head), 0)[sa]


def repeated_windows(parts: list[bytes], counts: np.ndarray, length: int = LENGTH, width: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of distinct contexts: for each, which of its windows start twice or more among all (a context counts as often
    as it was found); and, for merging, one (context, window) of each class of equal windows."""
    data = units(b"".join(parts), width)
    sizes = np.array([len(p) // width for p in parts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    part = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(data)) - first[part]
    valid = offset <= sizes[part] - length
    sa, rank = suffix_array(data)
    same = common_prefixes(data, sa, rank) >= length
    of = np.cumsum(~same) - 1
    weight = np.where(valid[sa], counts[part[sa]], 0)
    twice = np.bincount(of, weights=weight)[of] >= 2
    flag = np.zeros(len(data), dtype=bool)
    flag[sa] = twice & valid[sa]
    use = np.flatnonzero(valid[sa])
    one = sa[use[np.unique(of[use], return_index=True)[1]]]
    windows = [flag[f : f + max(0, s - length + 1)] for f, s in zip(first, sizes)]
    return windows, part[one], offset[one]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = 1, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """k, h and spans (array of first and end, in units, unmerged) for the rows with a string of length units that
    also starts elsewhere. rows: key, text_hash, body (bytes, width of them a unit)."""
    import xxhash

    key_type = rows.schema["key"].dataType

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                text, *found = contexts_of(list(part["body"]), length, gram, width)
                cuts = np.searchsorted(text, np.arange(1, len(part)))
                names = ("anchor", "digest", "first", "last", "twice")
                yield pd.DataFrame({"key": part["key"].array, "text_hash": part["text_hash"].array, **{c: np.split(f, cuts) for c, f in zip(names, found)}})

    long_enough = rows.where(F.octet_length("body") >= length * width).withColumn("key", F.col("key").cast("string"))
    placed = long_enough.mapInPandas(anchors, "key string, text_hash long, anchor array<long>, digest array<long>, first array<long>, last array<long>, twice array<long>")
    placed = materialize(placed.withColumn("key", F.col("key").cast(key_type)), "suffix-anchors")
    each = placed.select("key", "text_hash", F.explode(F.arrays_zip("anchor", "digest", "first", "last", "twice")).alias("c")).select("key", "text_hash", "c.*")
    known = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.max("twice").alias("twice"))
    known = known.where("n > 1 or twice = 1").select("anchor", ((F.col("least") != F.col("most")) | (F.col("n") == 1)).alias("several"))
    known = materialize(known, "suffix-known")  # read anew, so that a join on a hot anchor can be split
    found = materialize(each.drop("twice").join(known, "anchor"), "suffix-found")
    whole = found.where("not several").select("key", "text_hash", "first", (F.col("last") + length).alias("end"))
    several = found.where("several")
    distinct = several.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "text_hash", "first", "last")).alias("at"))
    distinct = materialize(distinct.select("anchor", "digest", "n", "at.*", ((F.col("at.last") - F.col("at.first") + length) * width).alias("size")), "suffix-contexts")
    total = distinct.agg(F.sum("size")).first()[0] or 0
    hot = distinct.groupBy("anchor").agg(F.sum("size").alias("all_bytes")).where(F.col("all_bytes") > hot_bytes)
    hot = materialize(hot, "suffix-hot")  # few rows: read anew, so that the join sees its size and can split a hot anchor
    n_shards = max(1, math.ceil(total / shard_bytes))
    salted = distinct.join(hot, "anchor", "left").withColumn("is_hot", F.col("all_bytes").isNotNull())
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("digest"), F.ceil(F.col("all_bytes") / hot_bytes))).otherwise(0)
    salted = salted.withColumn("n_buckets", F.when(F.col("is_hot"), F.ceil(F.col("all_bytes") / BUCKET_BYTES)).otherwise(0).cast("int"))
    salted = salted.withColumn("shard", F.pmod(F.xxhash64("anchor", salt), F.lit(n_shards)).cast("int"))
    per_doc = salted.groupBy("key", "text_hash").agg(F.collect_list(F.struct("anchor", "digest", "n", "first", "size", "shard", "n_buckets")).alias("cs"))
    # of repeated rows any will do: contexts of a place are the same
    texts = rows.join(per_doc.withColumnRenamed("key", "k").withColumnRenamed("text_hash", "h"), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    cut = texts.select("body", F.explode("cs").alias("c")).select("c.*", F.substring("body", F.col("c.first").cast("int") * width + 1, F.col("c.size").cast("int")).alias("bytes"))

    def sort_shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["anchor", "digest"]).sort_values(["anchor", "digest"])
        parts, counts = list(g["bytes"]), g["n"].to_numpy()
        flags, one_part, one_offset = repeated_windows(parts, counts, length, width)
        anchor, digest, buckets = g["anchor"].to_numpy(), g["digest"].to_numpy(), g["n_buckets"].to_numpy()
        out = [(anchor[i], digest[i], *map(list, zip(*found)), -1, None) for i, f in enumerate(flags) if (found := _ranges(f))]
        mine = buckets[one_part] > 0
        part, offset = one_part[mine], one_offset[mine]
        window = np.array([xxhash.xxh3_64_intdigest(parts[i][o * width : (o + length) * width]) for i, o in zip(part.tolist(), offset.tolist())], dtype=np.uint64)
        bucket = (window % np.maximum(buckets[part], 1).astype(np.uint64)).astype(np.int64)
        order = np.lexsort((window, bucket, anchor[part]))
        part, offset, window, bucket = part[order], offset[order], window[order], bucket[order]
        edges = np.flatnonzero((np.diff(anchor[part]) != 0) | (np.diff(bucket) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(part)]):
            if a < b:
                seen = np.fromiter((flags[i][o] for i, o in zip(part[a:b], offset[a:b])), dtype=bool, count=b - a)
                run = np.array([window[a:b].view(np.int64), digest[part[a:b]], offset[a:b], seen.astype(np.int64)], dtype="<i8")
                out.append((anchor[part[a]], 0, None, None, bucket[a], run.tobytes()))  # no nulls among 64-bit numbers: they would become floats
        return pd.DataFrame(out, columns=["anchor", "digest", "lo", "hi", "bucket", "run"])

    sorted_ = materialize(cut.groupBy("shard").applyInPandas(sort_shard, "anchor long, digest long, lo array<long>, hi array<long>, bucket long, run binary"), "suffix-ranges")
    ranges = sorted_.where("run is null").select("anchor", "digest", "lo", "hi")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        """Windows that several shards of an anchor hold, as ranges of their contexts."""
        window, digest, offset, seen = np.concatenate([np.frombuffer(r, dtype="<i8").reshape(4, -1) for r in g["run"]], axis=1)
        run = np.sort(window)
        hit = (np.searchsorted(run, window, side="right") - np.searchsorted(run, window, side="left") > 1) & (seen == 0)
        out = pd.DataFrame({"digest": digest[hit], "lo": offset[hit]}).sort_values(["digest", "lo"])
        fresh = (out["digest"] != out["digest"].shift()) | (out["lo"] != out["lo"].shift() + 1)
        spans = out.groupby(fresh.cumsum()).agg(digest=("digest", "first"), lo=("lo", "first"), hi=("lo", "last"))
        each = spans.assign(hi=spans["hi"] + 1).groupby("digest", as_index=False).agg(lo=("lo", list), hi=("hi", list))
        return each.assign(anchor=g["anchor"].iloc[0]).astype({"lo": object, "hi": object})[["anchor", "digest", "lo", "hi"]]

    dealt = sorted_.where("run is not null").groupBy("anchor", "bucket").applyInPandas(merge, "anchor long, digest long, lo array<long>, hi array<long>")
    ranges = materialize(ranges.union(dealt), "suffix-ranges")
    span = lambda first, end: F.struct(first.alias("first"), end.alias("end"))
    moved = F.transform(F.arrays_zip("lo", "hi"), lambda x: span(F.col("first") + x["lo"], F.col("first") + x["hi"] - 1 + length))
    part = several.join(ranges, ["anchor", "digest"]).select("key", "text_hash", moved.alias("spans"))
    all_spans = whole.select("key", "text_hash", F.array(span(F.col("first"), F.col("end"))).alias("spans")).union(part)
    return all_spans.groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged_spans(found) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["first"], x["end"]) for x in (found if found is not None else ())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), utf8(F.col(text)).alias("body"))


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """key, text_hash and n_repeated_words: how many words of a text lie in passages of so many words or more that also
    start elsewhere, whatever white space divides them. Texts without such passages have no row."""
    ship(docs.sparkSession)
    key_type = docs.schema[key].dataType

    @F.pandas_udf("binary")
    def codes(bodies: pd.Series) -> pd.Series:
        return bodies.map(word_codes)

    rows = rows_of(docs, key, text).where(F.octet_length("body") >= 2 * words - 1)
    coded = materialize(rows.select("key", "text_hash", codes("body").alias("body")), "suffix-words")
    found = repeated_spans(coded, words, gram, 4)

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [sum(e - s for s, e in merged_spans(x)) for x in batch["spans"]]
            yield pd.DataFrame({"key": batch["k"].array, "text_hash": batch["h"].array, "n_repeated_words": n})

    given = found.select(F.col("k").cast("string").alias("k"), "h", "spans")
    return given.mapInPandas(covered, "key string, text_hash long, n_repeated_words long").withColumn("key", F.col("key").cast(key_type))


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """key, text_hash, n_bytes, spans (array of start and end of each maximal removed run, in bytes) and kept (the other
    bytes) for each row of docs.

    Texts are taken as UTF-8; kept may cut a character. Null and empty texts, and those under length bytes, lose
    nothing. Rows that repeat an id and its text are documents of their own, so they lose what they share. Empty
    tables give no rows; other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    key_type = docs.schema[key].dataType
    rows = rows_of(docs, key, text)
    spans = repeated_spans(rows, length, gram, 1, shard_bytes, hot_bytes)


    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, h, body, found in zip(batch["key"].array, batch["text_hash"].array, batch["body"], batch["spans"]):
                merged = merged_spans(found)
                at, kept = 0, []
                for s, e in merged:
                    kept.append(body[at:s])
                    at = e
                kept.append(body[at:])
                out.append((k, h, len(body), [{"start": s, "end": e} for s, e in merged], b"".join(kept)))
            yield pd.DataFrame(out, columns=["key", "text_hash", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left").select(F.col("key").cast("string").alias("key"), "text_hash", "body", "spans")
    return joined.mapInPandas(remove, "key string, text_hash long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumn("key", F.col("key").cast(key_type))
