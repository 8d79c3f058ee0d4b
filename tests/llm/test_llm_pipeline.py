"""The pipeline's stages against brute force, each on what the stage before kept."""

import random
from collections import Counter

import numpy as np
from test_llm_exact import WORD, brute_base, brute_lines, brute_near

import corpus_pipeline
from tallyframe.llm import mixing, packing
from tallyframe.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = "Read more about this on our pages"
    texts = [f"{prose(70)}\n{common}\n{prose(30)}" if i % 3 == 0 else prose(100) for i in range(60)]
    texts += [" ".join(t.split()[:-2]) for t in texts[1:20:3]] + [texts[1], texts[1]]
    texts += [" ".join(f"junk{rng.randrange(8)}" for _ in range(80)) for _ in range(40)] + [None, "", "few words only"]
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        held = materialize(stage(spark, held, str(tmp_path)), name)
        after[name] = held.collect()

    kept = {r.doc_id: r.text for r in after["quality_rules"]}
    assert all(kept[i] == texts[i] for i in kept)
    clean = {i for i, t in enumerate(texts) if not brute_base(t)[-1] and "junk" not in (t or "")}
    assert set(kept) == clean  # the rejected: base rules, and the text unlike the trusted

    ids = sorted(kept)
    want = brute_lines_of({i: kept[i] for i in ids})
    lines = {r.doc_id: r for r in after["line_dedup"]}
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) for r in lines.values())

    near = brute_near([want[i] for i in ids])
    assert sorted(r.doc_id for r in after["near_dedup"]) == [i for n, i in enumerate(ids) if near[n][2]]

    sizes, source_of, totals = {}, {}, Counter()
    for r in after["near_dedup"]:
        sizes[r.doc_id], source_of[r.doc_id] = len(WORD.findall(r.text)), r.source
        totals[r.source] += sizes[r.doc_id]
    times, taken = Counter(r.doc_id for r in after["mixing"]), Counter()
    for i, n in times.items():
        assert n <= 3
        taken[source_of[i]] += n * sizes[i]
    target = mixing.targets(totals, (1, 2, 3))
    assert all(abs(taken[s] - target[s]) <= max(sizes.values()) for s in target)

    encode = packing.encoder(packing.tokenizer_path())
    by = Counter()
    for r in after["packing"]:
        by[r.doc_id] += r.length
    text_of = {r.doc_id: r.text for r in after["mixing"]}
    assert by == {i: n * (len(encode(text_of[i])) + 1) for i, n in times.items()}
    ends: dict[int, list] = {}
    for r in after["packing"]:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(ends) <= int(np.ceil(sum(by.values()) / 2048)) + 1


def brute_lines_of(texts: dict[int, str]) -> dict[int, str]:
    """brute_lines() works on places; ids keep their order here."""
    ids = sorted(texts)
    out = brute_lines([texts[i] for i in ids])
    return {i: out[n][2] for n, i in enumerate(ids)}


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """A repeated id loses copies only, and near copies without ids go too; the rows' order doesn't matter."""
    rng = random.Random(2)
    a, b, c, d, e = (" ".join(f"word{rng.randrange(60)}" for _ in range(80)) for _ in range(5))
    near = lambda t, x: f"{t} {x}"
    rows = [(5, a, "s0"), (5, a, "s1"), (5, b, "s0"), (5, near(b, "x"), "s0"), (-7, near(a, "y"), "s1"), (10, c, "s0"), (None, c, "s0"), (None, d, "s0"), (None, near(d, "z"), "s0"), (None, near(d, "z"), "s0"), (5, e, None), (5, "", "s0"), (5, "", "s0"), (6, "", "s0"), (None, None, "s0")]
    seen = set()
    for _ in range(2):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        out = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
        seen.add(frozenset(out))
        assert len(out) == len(set(out))
    (out,) = seen
    assert {x for x in out if not x[1]} == {(5, "", "s0"), (6, "", "s0"), (None, None, "s0")}
    full = {x for x in out if x[1]}
    assert {(-7, near(a, "y"), "s1"), (10, c, "s0"), (5, e, None)} <= full and len(full) == 5
    assert len(full & {(5, b, "s0"), (5, near(b, "x"), "s0")}) == 1 and len(full & {(None, d, "s0"), (None, near(d, "z"), "s0")}) == 1


def test_mixture_of_repeated_rows(spark):
    """Equal rows, rows of one id and rows without an id stay each as often as the mix takes them; extra columns with
    names used in between stay."""
    rows = [(1, "a b c", "s0", "k")] * 2 + [(1, "d e f g", "s0", "k"), (None, "h i", "s1", "k"), (None, "h i", "s1", "k"), (2, "", "s1", "k"), (3, None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __key string")
    out = Counter(tuple(r) for r in corpus_pipeline.mixture(spark, df, "").collect())
    n = Counter(rows)
    assert set(out) <= {r for r in rows if r[1]} and all(out[r] <= 3 * n[r] for r in out)
    want = mixing.targets({"s0": 10, "s1": 4, None: 0}, (1, 2, 3))
    for s in ("s0", "s1"):
        assert abs(sum(k * len(r[1].split()) for r, k in out.items() if r[2] == s) - want[s]) <= 2
