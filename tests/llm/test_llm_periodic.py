"""Periodic runs of words against brute force over all periods and starts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tallyframe.llm import periodic
from tallyframe.llm.queries import op13_periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, min_length=24, min_periods=3):
    """Longest stretches in which words q apart are equal, of those the ones with smallest period q."""
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_periods * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng, letters):
    """Words with many periodic stretches of all kinds, next to and inside each other."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(2, 5) + [rng.choice(letters)]
        out += unit * rng.randrange(1, 9)
        out += unit[: rng.randrange(len(unit))]
        out += [rng.choice(letters) for _ in range(rng.randrange(4))]
    return out


@pytest.mark.parametrize(("min_length", "min_periods"), [(24, 3), (6, 3), (3, 2), (10, 2), (9, 4)])
def test_runs_against_brute_force(min_length, min_periods):
    rng = random.Random(min_length)
    for i in range(300):
        words = made(rng, "ab" if i % 3 == 0 else "abcdefgh")
        want = brute(words, min_length, min_periods)
        assert periodic.find_runs(words, min_length, min_periods) == want
        assert periodic.runs_in([ord(w) for w in words], min_length, min_periods) == want


def test_positions():
    rng = random.Random(1)
    xs = rng.sample(range(20_000), 9000)
    held, plain = periodic.Positions(xs[0]), {xs[0]}
    for x in xs[1:]:
        before, after = max((y for y in plain if y < x), default=-1) if x % 50 == 0 else None, None
        got = held.insert(x)
        plain.add(x)
        assert before is None or got[0] == before
        assert after is None or got[1] == after
    assert list(held) == sorted(xs) and held.size == len(xs)
    assert all(held.after(x) == y for x, y in zip(sorted(xs), sorted(xs)[1:])) and held.after(max(xs)) == -1


def test_long_texts():
    assert periodic.find_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    unit = [str(i) for i in range(7000)]
    assert periodic.find_runs(["x", *unit * 3, "y"]) == [(1, 21_000, 7000)]
    assert periodic.find_runs(unit * 2) == []
    fib, last = ["a"], ["b"]
    while len(fib) < 5000:
        fib, last = fib + last, fib
    assert periodic.find_runs(fib[:900]) == brute(fib[:900])


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    told = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(told))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n", "few words", "\x1c\x85   odd\xa0spaces " * 9] + [" ".join(made(rng, ["a", "b", "é", "x\x1fy", " "])) for _ in range(60)]
    texts += [" ".join(rng.choice(["one", "two", "three", "four"]) + str(rng.randrange(40)) for _ in range(rng.randrange(400))) for _ in range(120)]
    rows = [(i, t, "en", "s", 1, "clash", 0) for i, t in enumerate(texts)] + [(8, texts[8], "en", "s", 1, "clash", 0)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, runs string, key int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 40
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, min_periods=1)
