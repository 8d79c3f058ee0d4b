"""Operators for training data against brute force on small inputs with nulls, empty texts, repeats and clashing names."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import line_dedup, media, mixing, near_dedup, packing, quality, sharding, suffix_dedup
from tallyframe.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, texts, source="s"):
    rows = [(i, t, "en", source if isinstance(source, str) else source(i), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "tau", "rho", "zeta", "eta", "iota"]) + str(rng.randrange(9)) for _ in range(n))


# --- sharding ---

def test_sharding_covers_all_rows_and_balances_bytes(spark):
    rng = random.Random(1)
    texts = [None, "", "é"] + [sentences(rng, rng.randrange(200)) for _ in range(400)]
    df = docs(spark, texts).withColumn("slot", F.lit("clash")).withColumn("shard", F.lit(1))
    out = sharding.shard(df, 8).collect()
    assert len(out) == len(texts)
    by = defaultdict(list)
    for r in out:
        t = (texts[r.key] or "").encode()
        assert (r["size"], r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    loads = [sum(r["size"] for r in rows) for rows in by.values()]
    assert max(loads) - min(loads) <= max(len((t or "").encode()) + 16 for t in texts)


def test_map_versions(spark):
    rng = random.Random(2)
    df = docs(spark, [sentences(rng, rng.randrange(1, 60)) for _ in range(200)])
    path = new_path(spark, "map")
    first = {r.key: r for r in sharding.shard(df, 4, map_path=path).collect()}
    again = {r.key: r for r in sharding.shard(df, 5, map_path=path).collect()}
    moved = [k for k in first if first[k].shard != again[k].shard]
    assert moved and all(again[k].shard == 4 for k in moved)
    assert (first[0].map_version, again[0].map_version) == (1, 2)
    assert sharding.load_map(spark, path, 1).n_shards == 4
    fewer = {r.key: r for r in sharding.shard(df, 3, map_path=path).collect()}
    assert set(fewer) == set(again) and all(r.shard < 3 and (r.shard == again[k].shard or again[k].shard >= 3) for k, r in fewer.items())
    assert sharding.load_map(spark, path).n_shards == 3
    with pytest.raises(ValueError):
        sharding.shard(df, 3, n_slots=64, map_path=path)
    assert sharding.shard(docs(spark, []), 3).count() == 0


# --- lines ---

def brute_lines(texts):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    rng = random.Random(3)
    common = ["  This Line is Common here ", "this line is common here\t", "Another line that repeats", "short", "x" * 30, " " + "y" * 19]
    texts = [None, "", "\n\n", "x" * 30 + "\n" + "x" * 30] + ["\n".join(rng.choice([*common, sentences(rng, 4)]) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    df = docs(spark, texts).withColumn("id", F.lit(1)).withColumn("k", F.lit(2)).withColumn("gone", F.lit("clash"))
    out = line_dedup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    got = {r.doc_id: (r["__n_lines"], r["__n_dropped"], r.text) for r in out.collect()}
    assert got == brute_lines(texts)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_columns_with_names_used_in_between(spark):
    """Extra columns named like those used in between, or like those added, harm nothing."""
    texts = ["one two three four five six seven eight nine ten eleven", None, "", "x " * 50_000]
    names = ["__v", "__lines", "__text_hash", "__gone", "__gone_id", "__kept", "__n_lines", "__salt", "__rank", "__at", "__read", "__error"]
    df = docs(spark, texts)
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    trusted = spark.createDataFrame([(0,)], "doc_id long")
    for out, made in ((quality.quality(df, trusted), quality.MADE), (line_dedup.dedup_lines(df), ("__n_lines", "__n_dropped"))):
        assert sorted(out.columns) == sorted({*df.columns, *made})
        assert all(r["__salt"] == "clash" and r["__v"] == "clash" for r in out.collect())
    pieces = packing.tokenize(df).withColumn("__salt", F.lit("clash")).withColumn("__at", F.lit("clash")).withColumn("offset", F.lit("clash"))
    out = packing.pack(pieces).collect()
    assert len({r.key for r in out}) == 4 and all(r["__at"] == "clash" and isinstance(r.offset, int) for r in out)
    images = media.read(media.store(df.withColumn("payload", media.padded(F.col("text")))))
    assert images.columns.count("__error") == 1 and {r["__read"] for r in images.collect()} == {"clash"}


# --- near duplicates ---

def brute_near(texts):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = [None, "", " \t", "One two", "one TWO", "one two three"]
    for _ in range(25):
        base = sentences(rng, rng.choice([6, 9, 30, 80])).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
            texts.append(" ".join(w))
    rng.shuffle(texts)
    df = docs(spark, texts).withColumn("key", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {r.key: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}
    assert got == brute_near(texts)
    assert near_dedup.near_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_links_that_no_star_shows(spark, monkeypatch, rounds):
    """Chains around a base: many members alike with their neighbours only, all in one bucket, which its centre leaves
    open. Small tiles of 4 members, so that all kinds are used, with and without further centres before."""
    seen = []
    whole = near_dedup.tiled
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "bands", lambda signature: np.zeros((len(signature), 1), dtype=np.int64))
    monkeypatch.setattr(near_dedup, "tiled", lambda members, written: seen.append(members.count()) or whole(members, written, tile=4, tile_shingles=200))
    rng = random.Random(5)
    base, texts = sentences(rng, 60).split(), []
    for k in range(30):
        w = list(base)
        for i in range(k, k + 3):
            w[i] = f"v{i}"
        for i in range(k):
            w[i] = f"v{i}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    want = brute_near(texts)
    got = {r.key: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert got == want and max(seen) > 8


def test_tiles_cover_every_pair_of_roots(spark):
    rows = [(7, i, 10, i if i > 20 else 0) for i in range(40)]
    members = spark.createDataFrame(rows, "bucket long, rep long, n_shingles long, root long")
    met = set()
    for r in near_dedup.tiled(members, tile=4, tile_shingles=100).groupBy("tile", "kind").agg(F.collect_list(F.struct("rep", "root", "is_top")).alias("m")).collect():
        assert len(r.m) <= 40
        met |= {frozenset((a.rep, b.rep)) for a in r.m for b in r.m if a.root != b.root and (r.kind == 1 or a.is_top != b.is_top)}
    assert met == {frozenset((a[1], b[1])) for a in rows for b in rows if a[3] != b[3]}


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    out = sorted((r.key or -1, r.component_id or -1, r.kept) for r in near_dedup.near_groups(df).collect())
    assert out == [(-1, -1, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_texts_that_share_an_id(spark):
    """Each text of a repeated id is linked by its own words: 4 and 6 are near one text of 5, 7 near another."""
    rng = random.Random(6)
    a, b, c = (sentences(rng, 60).split() for _ in range(3))
    near = lambda w, x: " ".join([*w[:-1], x])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(c)), (6, near(a, "x")), (4, near(a, "y")), (7, near(b, "z"))]
    out = sorted((r.key, r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(4, 4, True), (5, 4, False), (5, 5, True), (5, 5, True), (6, 4, False), (7, 5, False)]


# --- mixing ---

def test_targets():
    assert mixing.targets({"a": 10, "b": 10, None: 10}, (1, 2, 3)) == {"a": 5.0, "b": 10.0, None: 15.0}
    t = mixing.targets({"a": 100, "b": 1, "c": 1}, (1, 2, 3))
    assert t["b"] == 3.0 and t["c"] == 3.0 and t["a"] == 96.0


def test_flow_fills_overlapping_sources():
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 1}, {"a": 10, "b": 11})
    assert sum(given.values()) == 21 and given[("a", "b")] == 10  # nothing is repeated while unused documents fit
    assert mixing.route({("a",): 4}, {"a": 12}) == {("a",): 12}


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 50), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)] + [(None, 5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, size long, src string").withColumn("members", F.array("src")).withColumn("rank", F.lit("clash"))
    out = mixing.mix(df).collect()
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    want, taken = mixing.targets(sizes, (1, 2, 3)), Counter()
    for r in out:
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[r.members[0]] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 2 for s in want)
    again = {r.key: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.key: r.taken for r in out}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_of_repeated_rows(spark):
    """Equal rows and rows without an id are rows of their own: none exceeds 3 times its size, sums come near, and a
    class of equal rows is cut where its pattern is full."""
    rows = [(1, 3, "a")] * 50 + [(2, 7, "a")] * 3 + [(None, 4, "b")] * 40 + [(i, i, "c") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, size long, src string").withColumn("members", F.array("src")).withColumn("row", F.lit(1))
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    want, out = mixing.targets(sizes, (3, 1, 2)), mixing.mix(df, (3, 1, 2)).collect()
    taken = Counter()
    for r in out:
        assert r.taken % r["size"] == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[r.members[0]] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 4 for s in want)
    parts = Counter((r.key, r["size"], r.taken) for r in mixing.mix(df.repartition(7), (3, 1, 2)).collect())
    assert parts == Counter((r.key, r["size"], r.taken) for r in out)


# --- packing ---

def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 5)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(0, 4) == []


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    encode = packing.encoder(path)
    for t in ["", " ", "a  b\n\n c", "Ça été où naïve", "日本語 text", "x" * 5000, "<|endoftext|> it's 12345 we'll", "  　 tab\t", "\U0001f600 ok", "áb", "ŒœΑβ Жж"]:
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, 0, 0, rng.choice([3, 5, 7, 11, 16])) for i in range(300)] + [(None, 0, 0, 4)]
    df = spark.createDataFrame(rows, "key long, piece int, start long, length long").withColumn("offset_", F.lit(1))
    out = packing.pack(df, capacity=16).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 16
    assert len(by) <= sum(n for _, n in packing.best_fit(Counter(r[3] for r in rows), 16))
    assert packing.pack(df.limit(0), capacity=16).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("length", F.lit(17)), capacity=16)


def test_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 2: 2}
    plan = packing.complete_bins(counts, 12)
    used = Counter()
    for filling, n in plan:
        assert sum(filling) <= 12
        for x in filling:
            used[x] += n
    assert used == Counter(counts) and sum(n for _, n in plan) == packing.lower_bound(counts, 12)


def test_tokens_round_trip(spark):
    texts = [None, "", "hello world " * 2000, "é\n日本"]
    out = packing.tokenize(docs(spark, texts)).orderBy("key", "piece").collect()
    by = defaultdict(list)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert len(ids) == r.length <= 2048 and r.start == sum(map(len, by[r.key]))
        by[r.key].append(ids)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    for i, text in enumerate(texts):
        ids = np.concatenate(by[i])
        assert ids[-1] == 0 and t.decode(ids[:-1].tolist(), skip_special_tokens=False) == (text or "")
        assert all(len(p) == 2048 for p in by[i][1:])


def test_five_pieces_in_a_sequence():
    """Groups of copies give few lengths: only fillings of five pieces reach the bound, which best fit misses."""
    counts = {500: 40, 400: 120, 348: 40}
    assert sum(n for _, n in packing.best_fit(counts)) > 40 == sum(n for _, n in packing.complete_bins(counts))


def test_bins_against_every_partition():
    rng = random.Random(12)

    def least(pieces, rooms):
        """The fewest bins for pieces, by trying every open bin and a new one for each."""
        if not pieces:
            return len(rooms)
        n, *rest = pieces
        tried = {r: least(rest, sorted([*rooms[:i], r - n, *rooms[i + 1 :]])) for i, r in enumerate(rooms) if r >= n}
        return min([least(rest, sorted([*rooms, 20 - n])), *tried.values()])

    for _ in range(40):
        pieces = sorted((rng.randrange(3, 15) for _ in range(rng.randrange(1, 8))), reverse=True)
        plan = packing.complete_bins(Counter(pieces), 20)
        assert Counter(x for f, n in plan for x in f * n) == Counter(pieces) and all(sum(f) <= 20 for f, _ in plan)
        assert sum(n for _, n in plan) == least(pieces, [])


def test_both_libraries_give_the_same_ids():
    """Every text of the smallest table, and texts with unusual characters."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encode, own = packing.encoder(path), Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    for t in [*texts, "<|endoftext|> x", "日本語 текст", "a" * 5000, "\u2028\x00 \n\n  tabs\t\t", "🙂 e\u0301"]:
        assert encode(t or "").tolist() == own.encode(t or "", add_special_tokens=False).ids


# --- media ---

@pytest.mark.parametrize("kind", range(5))
def test_png_round_trip(kind):
    payload = random.Random(kind).randbytes(64 * 9)
    assert media.decode_png(media.encode_png(payload, filters=kind)).tobytes() == payload


def test_png_mixed_filters_and_faults(monkeypatch):
    rng = random.Random(19)
    payload = random.Random(9).randbytes(64 * 12)
    png = media.encode_png(payload, filters=np.array([0, 1, 2, 3, 4, 2, 2, 1, 4, 3, 0, 2]))
    assert media.decode_png(png).tobytes() == payload
    monkeypatch.setattr(media, "TALL", 5)
    assert media.decode_png(png).tobytes() == payload
    monkeypatch.setattr(media, "TOGETHER", 3000)
    payloads = [bytes(rng.choice(b"abc \0\xff") for _ in range(64 * rng.randrange(1, 9))) for _ in range(40)]
    images = [media.encode_png(p) for p in payloads]
    kinds = np.concatenate([media.filtered_rows(m)[:, 0] for m in images])
    assert set(kinds.tolist()) == {0, 1, 2, 3, 4}  # chosen row by row
    back = media.decode_pngs([b"no image", *images])
    assert isinstance(back[0], ValueError) and [p.tobytes() for p in back[1:]] == payloads
    bomb = struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)
    huge = media.SIGNATURE + media._chunk(b"IHDR", bomb) + media._chunk(b"IDAT", zlib.compress(bytes(10_000_000))) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.decode_png(huge)
    for bad in (png[:-3], png[:50] + bytes([png[50] ^ 1]) + png[51:], b"GIF" + png[3:], b""):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 100_000, "a"]
    df = docs(spark, texts).withColumn("payload", media.padded(F.col("text"))).withColumn("payload_", F.lit("clash"))
    out = {r.doc_id: r for r in media.read(media.store(df).drop("payload")).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert bytes(out[i]["__payload"]) == b + b"\0" * (-len(b) % 64 or (64 if not b else 0))
    assert out[2]["__feature"] == out[6]["__feature"] and bytes(out[2].media) == bytes(out[6].media)
    bad = spark.createDataFrame([(1, bytearray(b"no png")), (2, None)], "k int, media binary")
    assert {r.k: (r["__payload"], bool(r["__error"])) for r in media.read(bad).collect()} == {1: (None, True), 2: (None, False)}


# --- passages ---

def brute_passages(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(b, gone) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return out


@pytest.mark.parametrize("shard,hot,bucket", [(1 << 20, 1 << 19, 1 << 22), (2000, 400, 900)])
def test_passages(spark, monkeypatch, shard, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    common = [noise(n) for n in (30, 45, 60, 100)]
    texts = [None, "", "ab" * 100, "a" * 150, "é" * 60]
    for _ in range(80):
        t = noise(rng.randrange(80))
        for _ in range(rng.randrange(4)):
            p = rng.choice(common)
            t += p[rng.randrange(10) : len(p) - rng.randrange(10)] + noise(rng.randrange(40))
        texts.append(t)
    texts.append(texts[9])
    df = docs(spark, texts).withColumn("key", F.lit("clash")).withColumn("anchor", F.lit(1))
    got = {r.key: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.dedup_passages(df, length=40, gram=10, shard_bytes=shard, hot_bytes=hot).collect()}
    assert got == dict(enumerate(brute_passages(texts, 40)))
    assert suffix_dedup.dedup_passages(docs(spark, [])).count() == 0


def test_passages_in_words(spark):
    """Copies differ in white space only; a passage of one word less than asked for doesn't count."""
    rng = random.Random(18)
    vocabulary = [f"w{i}" for i in range(500)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = [words(n) for n in (11, 12, 15, 30)]
    texts = [[], ["one"], common[0], ["x"] * 40]
    for _ in range(60):
        t = words(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            t = t + rng.choice(common) + words(rng.randrange(10))
        texts.append(t)
    df = docs(spark, [None] + [rng.choice([" ", "\n", "  "]).join(t) for t in texts])
    got = {r.key - 1: r.n_repeated_words for r in suffix_dedup.repeated_words(df, words=12, gram=4).collect()}
    count = Counter(tuple(t[i : i + 12]) for t in texts for i in range(len(t) - 11))
    want = {}
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 11) if count[tuple(t[i : i + 12])] > 1 for j in range(i, i + 12)}
        if gone:
            want[k] = len(gone)
    assert got == want


def test_suffix_array_and_prefixes():
    rng = random.Random(10)
    for data in (b"", b"a", b"aaaaaaaaaaaaaaaaaaaa", b"\0\0\0\0\0\0\0\0\0\0\0", b"banana" * 5, bytes(rng.choice(b"ab\0") for _ in range(300))):
        x = np.frombuffer(data, dtype=np.uint8)
        sa, rank = suffix_dedup.suffix_array(x)
        want = sorted(range(len(data)), key=lambda i: data[i:])
        assert sa.tolist() == want
        lcp = suffix_dedup.common_prefixes(x, sa, rank).tolist()
        for k in range(1, len(want)):
            a, b = data[want[k - 1] :], data[want[k] :]
            n = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert lcp[k] == n
    for values in ([], [7], [0, 0, 0], [1, 1 << 31, 1, 1 << 31, 0], [rng.randrange(3) << 20 for _ in range(200)]):
        x = np.array(values, dtype="<u4")
        sa, rank = suffix_dedup.suffix_array(x)
        assert sa.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
        lcp = suffix_dedup.common_prefixes(x, sa, rank).tolist()
        for k in range(1, len(values)):
            a, b = values[sa[k - 1] :], values[sa[k] :]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


# --- quality ---

def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, cov = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            cov |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)


def test_quality(spark):
    rng = random.Random(11)
    good = [sentences(rng, 60) for _ in range(60)]
    bad = [" ".join(f"junk{rng.randrange(10)}" for _ in range(60)) for _ in range(60)]
    odd = [None, "", " \n\t", "a b c d e " * 5, "a b c d e f g h i j k\na b c\na b c", "# $ | <x>", "é ü ö", "w " * 30]
    texts = good + bad + odd
    df = docs(spark, texts).withColumn("__wh", F.lit("clash")).withColumn("id", F.lit(1))
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (10**9,)], "doc_id long")
    out = quality.quality(df, trusted)
    assert out.columns[: len(df.columns)] == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"], r["__base_failed"]) == brute_base(t), t
    assert all(rows[i]["__kept"] for i in range(len(good)) if not rows[i]["__base_failed"])
    assert not any(rows[i]["__kept"] for i in range(len(good), len(good) + len(bad)))
    assert {r.doc_id for r in out.where("__kept").collect()} == {i for i in rows if rows[i]["__kept"]}
    assert quality.quality(docs(spark, []), trusted).count() == 0
    assert quality.quality(df, trusted.limit(0)).where("__kept").count() == sum(not r["__base_failed"] for r in rows.values())




def test_likely_rows_lose_none_and_pass_few_others(spark):
    from tallyframe.llm import common

    df = spark.range(200_000).withColumn("h", F.xxhash64("id")).union(spark.createDataFrame([(-1, None)], "id long, h long"))
    wanted = df.where("id % 50 = 0").select(F.col("h").alias("w"))
    kept = common.likely_rows(df, "h", wanted, "w")
    ids = {r.id for r in kept.select("id").collect()}
    assert set(range(0, 200_000, 50)) <= ids and len(ids) < 4000 + 200_000 / 10
    assert common.likely_rows(df, "h", wanted.limit(0), "w").count() == 0
    most, common.MOST_BITS = common.MOST_BITS, 1 << 12
    try:
        assert common.likely_rows(df, "h", wanted, "w").count() == 200_001  # too many for the bitmap: all rows
    finally:
        common.MOST_BITS = most
