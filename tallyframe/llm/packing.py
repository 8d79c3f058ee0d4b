"""Packing token sequences: tokenise, cut, and fill sequences of a fixed length by bin completion.

Pieces of one length are interchangeable, so only the number of pieces of each length (at most one row per possible
length) comes to the driver. There a best-fit solution is the first incumbent; if it isn't at the lower bound,
bin completion by branch and bound looks for a better one: around the largest remaining length it enumerates
undominated fillings of any number of pieces and prunes by the waste that the incumbent allows. The plan is a list of fillings with the
number of times each is used; pieces find their place in it by their rank within their length.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import free_names, materialize, other_columns, utf8
from tallyframe.session import ship

CAPACITY = 2048
END = 0
#: Fillings tried at each level of the search, pieces looked at to find them, and steps in all: beyond them the best
#: solution so far stands.
WIDTH, LOOKS, STEPS = 4, 3000, 600
Filling = tuple[int, ...]

_UNUSUAL = re.compile("[^\x00-ɏ‐-‧]")
_LONG_RUN = re.compile(r"\S{2000}")
_tokenizers: dict[str, tuple] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from texts to arrays of ids. Where a file of the same name with the vocabulary as ranks lies beside
    the tokenizer's, usual texts go through the faster library, which gives the same ids; texts with unusual
    characters or very long words go through the tokenizer itself. Strings of special tokens are ordinary text."""
    if path not in _tokenizers:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        slow, fast = Tokenizer.from_file(path), None
        slow.encode_special_tokens = True
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        _tokenizers[path] = slow, fast
    slow, fast = _tokenizers[path]

    def encode(text: str) -> np.ndarray:
        if fast is None or _UNUSUAL.search(text) or _LONG_RUN.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text), dtype="<u4")

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: all of full length, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, at + capacity) for at in range(first, n, capacity))] if n else []


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every whole text: key, piece, start, length, ids (little-endian unsigned 32-bit). Each document ends
    with the id END, so null and empty texts are one piece of one id. Repeated rows give their pieces each."""
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    key_type = docs.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, rows, held = encoder(path), [], 0
        for batch in batches:
            for k, body in zip(batch["key"].array, batch["body"]):
                ids = np.append(encode(body.decode("utf-8", "replace")), np.array([END], dtype="<u4"))
                for i, (a, b) in enumerate(cut(len(ids), capacity)):
                    rows.append((k, i, a, b - a, ids[a:b].tobytes()))
                held += 4 * len(ids)
                if held > 8 << 20:
                    yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids"]).astype({"key": batch["key"].dtype})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids"]).astype({"key": batch["key"].dtype})
                rows, held = [], 0

    # ids travel as text so that nulls and large numbers keep their values
    given = docs.select(F.col(key).cast("string").alias("key"), utf8(F.col(text)).alias("body"))
    return given.mapInPandas(pieces, "key string, piece int, start long, length long, ids binary").withColumn("key", F.col("key").cast(key_type))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Longest first, each into the fullest sequence with room; equal sequences are handled together."""
    open_by_room: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                k = max(1, min(capacity // length, left))
                full, rest = divmod(left, k)
                put(capacity - k * length, (length,) * k, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[i]
            filling, n = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[i]
            used = min(n, left)
            if n > used:
                put(room, filling, n - used)
            put(room - length, (*filling, length), used)
            left -= used
    return [g for groups in open_by_room.values() for g in groups]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """The tokens over the capacity, or, if more, the bound by pieces of over half of it that shut out others."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in sorted({n for n in counts if 2 * n <= capacity} | {0}):
        large = sum(c for n, c in counts.items() if n > capacity - k)
        mid = [(n, c) for n, c in counts.items() if capacity // 2 < n <= capacity - k]
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        room = sum((capacity - n) * c for n, c in mid)
        best = max(best, large + sum(c for _, c in mid) + max(0, -(-(small - room) // capacity)))
    return best


def reachable(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each k the sums up to room of pieces of the k least lengths, as bits of a number."""
    out, every = [1], (1 << room + 1) - 1
    for n in lengths:
        bits, left, take = out[-1], min(counts[n], room // n), 1
        while left:  # counts as powers of two
            take = min(take, left)
            bits |= bits << take * n
            left -= take
            take *= 2
        out.append(bits & every)
    return out


def fillings(lengths: list[int], counts: dict[int, int], room: int, spare: int, looks: int = LOOKS) -> Iterator[Filling]:
    """Undominated fillings of a room with any number of pieces, least waste first, the longest pieces first, as long
    as the waste is at most spare. A filling is dominated if two of its pieces could be one piece of the same size, or
    if more or longer pieces fit: those fillings have less waste and come before. The sums that can be reached are known
    beforehand, so only domination ends a branch. At most looks pieces are looked at."""
    reach = reachable(lengths, counts, room)
    left = looks

    def walk(k: int, target: int, used: Filling) -> Iterator[Filling]:
        nonlocal left
        if not target:
            yield used
            return
        for j in range(min(k, bisect.bisect_right(lengths, target)), 0, -1):
            left -= 1
            if left < 0:
                return
            n = lengths[j - 1]
            if any(counts.get(n + x, 0) for x in used):
                continue
            for c in range(min(counts[n], target // n, 1 if counts.get(2 * n, 0) else counts[n]), 0, -1):
                if reach[j - 1] >> target - c * n & 1:
                    yield from walk(j - 1, target - c * n, (*used, *(n,) * c))

    for waste in range(min(spare, room) + 1):
        if left >= 0 and reach[-1] >> room - waste & 1:
            yield from walk(len(lengths), room - waste, ())


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used: the best of best_fit() and what branch and bound finds in its steps.
    A filling is used as often as its pieces last."""
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    total, n_best, bound = sum(n * c for n, c in counts.items()), sum(c for _, c in best), lower_bound(counts, capacity)
    left = dict(counts)
    path: list[tuple[Filling, int]] = []
    wasted = 0
    stack: list[tuple[Iterator[Filling], int]] = []

    def branches() -> Iterator[Filling]:
        lengths = sorted(n for n, c in left.items() if c)
        big = lengths[-1]
        left[big] -= 1
        spare = (n_best - 1) * capacity - total - wasted  # the waste that a better solution may still have
        out = [(big, *f) for f in itertools.islice(fillings([n for n in lengths if left[n]], left, capacity - big, spare), width)] if spare >= 0 else []
        left[big] += 1
        return iter(out)

    if n_best > bound:
        stack.append((branches(), 0))
    while stack and n_best > bound and steps > 0:
        filling = next(stack[-1][0], None)
        if filling is None:
            stack.pop()
            if path:
                done, n = path.pop()
                wasted -= (capacity - sum(done)) * n
                for x in done:
                    left[x] += n
            continue
        steps -= 1
        n = min(left[x] // filling.count(x) for x in set(filling))
        more = (capacity - sum(filling)) * n
        if -(-(total + wasted + more) // capacity) >= n_best:
            # fewer uses of a wasteful filling may still do
            spare = (n_best - 1) * capacity - total - wasted
            n = min(n, spare // max(1, capacity - sum(filling)))
            if n < 1:
                continue
            more = (capacity - sum(filling)) * n
        for x in filling:
            left[x] -= n
        path.append((filling, n))
        wasted += more
        if any(left.values()):
            stack.append((branches(), 0))
            continue
        used = sum(c for _, c in path)
        if used < n_best:
            best, n_best = list(path), used
        done, n = path.pop()
        wasted -= more
        for x in done:
            left[x] += n
    return best


class Places:
    """Where the piece of a rank within its length lies: sequence and offset."""

    def __init__(self, plan: list[tuple[Filling, int]]):
        rows: dict[int, list[tuple[int, int, list[int]]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for filling, n in plan:
            ends = np.cumsum(filling)
            at: dict[int, list[int]] = {}
            for end, x in zip(ends, filling):
                at.setdefault(x, []).append(int(end) - x)
            for x, offsets in at.items():
                rows.setdefault(x, []).append((taken.get(x, 0), sequence, offsets))
                taken[x] = taken.get(x, 0) + n * len(offsets)
            sequence += n
        self.first = {x: np.array([r[0] for r in r_]) for x, r_ in rows.items()}
        self.base = {x: np.array([r[1] for r in r_]) for x, r_ in rows.items()}
        self.each = {x: np.array([len(r[2]) for r in r_]) for x, r_ in rows.items()}
        self.start = {x: np.concatenate([[0], np.cumsum([len(r[2]) for r in r_])[:-1]]).astype(int) for x, r_ in rows.items()}
        self.offsets = {x: np.array([o for r in r_ for o in r[2]]) for x, r_ in rows.items()}

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.first[length], rank, side="right") - 1
        nth = rank - self.first[length][i]
        each = self.each[length][i]
        return self.base[length][i] + nth // each, self.offsets[length][self.start[length][i] + nth % each]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 within a sequence) to pieces, which have key, piece, start and
    length (1 to capacity); any other columns stay, whatever their names, but for a sequence_id and an offset, which
    are replaced. Equal rows are pieces of their own, in any order. Empty tables stay empty.

    Ranks within a length are counted per (length, salt) group and shifted by the sums of the groups before, so a
    length that most pieces have is spread over many tasks."""
    ship(pieces.sparkSession)
    held = materialize(pieces, "pack-pieces")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"a piece has a length outside 1 to {capacity}")
    places = held.sparkSession.sparkContext.broadcast(Places(complete_bins(counts, capacity)))
    n_salts = max(64, math.ceil(sum(counts.values()) / rows_per_salt))
    salt, so_far, rank, at = free_names(pieces, "__salt", "__before", "__rank", "__at")
    salted = held.withColumn(salt, F.pmod(F.xxhash64("key", "piece", "start"), F.lit(n_salts)))
    groups = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", salt, F.coalesce(before, F.lit(0)).alias(so_far))
    nth = F.row_number().over(Window.partitionBy("length", salt).orderBy("key", "piece", "start"))
    ranked = salted.join(groups, ["length", salt]).withColumn(rank, F.col(so_far) + nth - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(n)), dtype=np.int64)
        for x in np.unique(n):
            own = n == x
            out[:, own] = places.value.find(int(x), r[own])
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    return ranked.withColumn(at, place("length", rank)).select(*other_columns(pieces, "sequence_id", "offset"), F.col(f"{at}.sequence_id"), F.col(f"{at}.offset"))
