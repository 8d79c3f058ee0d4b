"""Periodic runs of words in a text: stretches that repeat themselves, found by a suffix automaton, and collapsed.

A run is a longest stretch with smallest period q that holds at least min_periods periods and min_length words. The
automaton's states hold the ordered set of their end positions, merged from the longest state down, small sets into
large. Where two positions a < b become neighbours in the set of a state of length L and b - a <= L, the L words up to a
and up to b are equal and overlap or touch: a square. Neighbours within the whole set are a smallest period apart, and a state is
as long as the words before a and b agree, so the square already reaches its run's left end; one whose next words
differ reaches the right end too and is that run, L + b - a words long. Squares that go on to the right are beginnings
of a run that another pair gives.

Every word of a run lies in a window of min_length * (1 - 1 / min_periods) words, about, that the text holds twice, so
automata are built over the stretches that such windows cover; other text can't be part of a run. Each row stands alone
and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import ship

MIN_LENGTH, MIN_PERIODS = 24, 3
_BASE = 0x9E3779B97F4A7C15
#: Positions in one block of an ordered set.
BLOCK = 1024
#: Bytes of collapsed text in one batch, about.
BATCH = 4 << 20


class Positions:
    """An ordered set of integers in blocks, so that insertion stays cheap however many there are."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def insert(self, x: int) -> tuple[int, int]:
        """Adds x, which isn't in the set; gives its neighbours, -1 for none."""
        blocks, tops = self.blocks, self.tops
        b = min(bisect_left(tops, x), len(tops) - 1)
        block = blocks[b]
        i = bisect_left(block, x)
        block.insert(i, x)
        before = block[i - 1] if i else blocks[b - 1][-1] if b else -1
        after = block[i + 1] if i + 1 < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else -1
        if i + 1 == len(block):
            tops[b] = x
        if len(block) > 2 * BLOCK:
            blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            tops.insert(b, block[BLOCK - 1])
        self.size += 1
        return before, after

    def after(self, x: int) -> int:
        """The least member over x, -1 for none."""
        b = bisect_right(self.tops, x)
        return self.blocks[b][bisect_right(self.blocks[b], x)] if b < len(self.blocks) else -1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a word, without its arrows: for each state its suffix link, its length, and the
    position that it ends at where it is a prefix, -1 for clones and the root."""
    arrows: list[dict] = [{}]
    link, length, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        arrows.append({})
        length.append(i + 1)
        ends.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in arrows[p]:
            arrows[p][c] = new
            p = link[p]
        if p >= 0:
            q = arrows[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = new + 1
                arrows.append(arrows[q].copy())
                length.append(length[p] + 1)
                ends.append(-1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and arrows[p].get(c) == q:
                    arrows[p][c] = clone
                    p = link[p]
        last = new
    return link, length, ends


def shortest_state(min_length: int, min_periods: int) -> int:
    """No run's last square stands at a shorter state: the least of a run's length less its period."""
    return min(max(min_length, min_periods * q) - q for q in range(1, min_length + 1))


def runs_in(word: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a sequence of numbers as (start, length, period), by start, then period."""
    n = len(word)
    if n < min_length:
        return []
    link, length, ends = automaton(word)
    least = shortest_state(min_length, min_periods)
    held: list[Positions | int | None] = [e if e >= 0 else None for e in ends]
    squares: dict[int, list[tuple[int, int]]] = {}
    found = []
    for v in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        mine = held[v]
        for a, b in squares.pop(v, ()):  # the set is whole now
            if mine.after(a) == b:
                found.append((b - (b - a) - length[v] + 1, length[v] + b - a, b - a))
        up = link[v]
        if up < 0 or length[up] < least:
            held[v] = None
            continue
        reach = length[up]
        other, held[v] = held[up], None
        if other is None:
            held[up] = mine
            continue
        if isinstance(other, int):
            other = Positions(other)
        small: Positions | tuple
        if isinstance(mine, int):
            small, large = (mine,), other
        else:
            small, large = (mine, other) if mine.size <= other.size else (other, mine)
        last = -1
        for x in small:
            before, after = large.insert(x)
            if before == last:  # neighbours before, in the small set
                before = -1
            last = x
            for a, b in ((before, x), (x, after)):
                d = b - a
                if 0 <= a < b and (min_periods - 1) * d <= reach and reach + d >= min_length and (b + 1 == n or word[a + 1] != word[b + 1]):
                    squares.setdefault(up, []).append((a, b))
        held[up] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of each window of so many values."""
    made, have, power, width = None, 0, values, 1
    while size:
        if size & 1:
            if made is None:
                made, have = power, width
            else:
                m = len(power) - have
                made, have = made[: max(0, m)] * np.uint64(pow(_BASE, width, 1 << 64)) + power[have:], have + width
        size >>= 1
        if size:
            power = power[: max(0, len(power) - width)] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
            width *= 2
    return made


def repeated_stretches(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int]]:
    """Bounds of the stretches that may hold runs: those covered by windows that occur twice."""
    n, size = len(words), shortest_state(min_length, min_periods)
    if n < min_length:
        return []
    hashed = window_hashes(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), size)
    ordered = np.sort(hashed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(hashed, twice))
    cuts = np.flatnonzero(np.diff(at) > size)
    starts, ends = at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]] + size
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= min_length]


def find_runs(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a list of words as (start, length, period), by start, then period. Memory: some 500 bytes for each
    word of the longest repeated stretch."""
    out = []
    for a, b in repeated_stretches(words, min_length, min_periods):
        numbers: dict = {}
        found = runs_in([numbers.setdefault(w, len(numbers)) for w in words[a:b]], min_length, min_periods)
        out += [(a + s, m, q) for s, m, q in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for a, b in sorted((s + q, s + m) for s, m, q in runs):
        kept += words[at : max(at, a)]
        at = max(at, b)
    return kept + words[at:]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per row of df: key, n_words, runs (array of start, length, period; words are counted from 0; by start,
    then period) and collapsed (the words that stay, joined by one space).

    Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words: no runs and an empty text. Every row counts
    by itself, so repeated rows, ids and null ids give a row each. Runs may overlap; each is given. Whole texts are
    searched. Other columns of df are not read, whatever their names; an empty table gives no rows. min_periods must
    be 2 or more, min_length min_periods or more."""
    if min_periods < 2 or min_length < min_periods:
        raise ValueError("a run has two periods and as many words as periods, at least")
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size, held = 0, 0, ([], [], [])
            for i, data in enumerate(b.column(1)):
                words = data.as_py().split()  # bytes: at the white space of ASCII
                runs = find_runs(words, min_length, min_periods)
                told = b" ".join(collapse(words, runs)).decode()
                for into, x in zip(held, (len(words), [{"start": s, "length": m, "period": q} for s, m, q in runs], told)):
                    into.append(x)
                size += len(told)
                if size > BATCH or i + 1 == len(b):
                    columns = [b.column(0).slice(at, i + 1 - at), pa.array(held[0], pa.int64()), pa.array(held[1], kind), pa.array(held[2], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "collapsed"])
                    at, size, held = i + 1, 0, ([], [], [])

    return rows.mapInArrow(search, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods (exactly; ties: least start, then period); null without runs."""
    first = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(first(r, best), r).otherwise(best))
