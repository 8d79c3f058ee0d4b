"""Extraction, toxicity and the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import html_extract, toxicity
from tallyframe.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies</div><article><h1>The  title</h1><p>First &amp; <b>bold</b>
 paragraph that is long enough to be content for sure, with many words.</p><ul><li>One item<li>Two item</ul><p>Second paragraph, also of some length, ends the article.</article>
<section id="comments"><p>A reader says a very long thing that is not part of the article at all, on and on and on.</p></section><footer>Imprint</footer></body></html>"""


def test_main_text_in_wrappers_and_beside_the_largest_block():
    long = [f"Sentence {i} of the text is long enough to be taken for content, with many more words in it." for i in range(10)]
    body, menu = "".join(f"<p>{x}</p>" for x in long), "<ul class='menu'><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul>"
    text = "\n".join(long)
    for page in (
        f"<body><div class='layout has-sidebar'>{menu}<article>{body}</article><div class='sidebar'><p>{long[0]}</p></div></div></body>",
        f"<body><div id='page' class='menu-open'>{menu}<div>{body}</div></div></body>",
        f"<body><div>{menu}</div><div class='related'><p>{long[0]}</p></div><article>{body}</article></body>",
    ):
        assert html_extract.main_text(page) == text
    named = f"<article>{body}<h2 id='related-work'>Related work</h2><p class='share-price'>The share price rose.</p><p class='share'>Share this</p></article>"
    assert html_extract.main_text(named) == f"{text}\nRelated work\nThe share price rose."
    split = f"<body>{menu}<div><h1>The title</h1><div class='intro'>{long[0]}</div><div class='text'>{body}</div></div></body>"
    assert html_extract.main_text(split) == f"The title\n{long[0]}\n{text}"


def test_main_text():
    assert html_extract.main_text(PAGE) == "The title\nFirst & bold paragraph that is long enough to be content for sure, with many words.\nOne item\nTwo item\nSecond paragraph, also of some length, ends the article."


def made_page(rng, article: bool, named: bool) -> tuple[str, str]:
    """A page and its main text. Without article the text is in a div among other divs; without names nothing but the
    shape of the blocks says which."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    links = lambda n: "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n))
    name = lambda x: f" class='{x}'" if named else ""
    blocks, text = [], []
    for k in range(rng.randrange(3, 9)):
        t = prose(rng.randrange(25, 60))
        text.append(t)
        blocks.append(f"<p>{t.replace(' ', chr(10), 1)}</p>")
        if k == 1:
            items = [prose(6), prose(8)]
            text += items
            blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
    title = prose(6)
    body = f"<h1>{title}</h1>" + "".join(blocks)
    main = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    for _ in range(rng.randrange(3)):
        main = f"<div>{main}</div>"
    menu, foot = f"<div{name('menu')}><ul>{links(6)}</ul></div>", f"<div{name('footer')}><ul>{links(8)}</ul></div>"
    side = f"<div{name('sidebar')}><b>{word()}</b><ul>{links(5)}</ul></div>"
    return f"<html><body><div>{menu}{main}{side}{foot}</div></body></html>", "\n".join([title, *text])


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("named", [True, False])
def test_main_text_of_made_pages(article, named):
    rng = random.Random(7)
    for _ in range(60):
        page, text = made_page(rng, article, named)
        assert html_extract.main_text(page) == text


def test_the_threshold_decides(monkeypatch):
    """Without names, nothing but the ratios tells the text from the menus: with every line as content they stay."""
    rng = random.Random(8)
    pages = [made_page(rng, False, False) for _ in range(20)]
    assert all(html_extract.main_text(page) == text for page, text in pages)
    monkeypatch.setattr(html_extract, "threshold", lambda x: -1.0)
    assert all(html_extract.main_text(page) != text for page, text in pages)


def test_two_articles_and_ties():
    """Of several articles those with half the votes of the largest stay, equal ones both, in page order."""
    a, b, c = (f"Article {x} has a paragraph that is long enough to be content, with many more words in it." for x in "abc")
    page = f"<main><article><p>{a}</p></article><article><p>{b}</p></article><article><p>Short.</p></article></main>"
    assert html_extract.main_text(page) == f"{a}\n{b}"
    assert html_extract.main_text(f"<body><article><p>{c}</p></article><footer><p>{a} {b}</p></footer></body>") == c


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>"), (4, "plain text only"), (5, "<div>" * 3000 + "deep text here" + "</div>" * 3000), (6, PAGE)], "page_id long, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert out[1] == out[2] == out[3] == "" and out[4] == "plain text only" and out[5] == "deep text here" and out[6].startswith("The title")
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_interaction_is_learned():
    """Neither term alone is toxic; both together are. An additive model can't say that."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        t = {rng.randrange(1000, 1040) for _ in range(6)} | ({1} if a else set()) | ({2} if b else set())
        rows.append(np.array(sorted(t)))
        labels.append(float(a and b))
    m = toxicity.fit(rows, np.array(labels))
    score = lambda *t: toxicity.sigmoid(m.margins([m.places(np.array(t))]))[0]
    assert score(1, 2) > 0.5 > max(score(1), score(2), score(1000))


def test_scores_and_held_out_rows(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.25
        rows.append((i, " ".join([word() for _ in range(30)] + (["idiot", "scum"] if toxic else []))))
        labels.append((i, int(toxic)))
    extra = [(10_000, None), (10_001, ""), (None, "idiot scum")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit("clash"))
    given = spark.createDataFrame([*labels, (None, 1), (10_000, None)], "doc_id long, toxic int")
    out = {r.doc_id: r["__score"] for r in toxicity.toxicity(df, given).collect()}
    assert len(out) == 603 and all(0 <= s <= 1 for s in out.values())
    wrong = sum((out[i] >= toxicity.THRESHOLD) != bool(t) for i, t in labels)
    assert wrong <= 10 and out[10_000] == out[10_001] < toxicity.THRESHOLD
    flipped = given.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r["__score"] for r in toxicity.toxicity(df, flipped).collect()} == out  # held-out labels teach nothing
    assert len({r["__score"] for r in toxicity.toxicity(df, given.limit(0)).collect()}) == 1


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, tmp_path, empty):
    rng = random.Random(3)
    text = lambda: " ".join(f"word{rng.randrange(40)}" for _ in range(80))
    rows = []
    if not empty:
        base = [text() for _ in range(20)]
        rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
        rows += [(100 + i, base[i], "en", "s0", 1) for i in range(5)] + [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, text(), "en", None, 1), (3, base[3], "en", "s0", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__kept", F.lit("clash")).drop("__kept")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, counts = df, []
    for name, stage in corpus_pipeline.STAGES:
        held = materialize(stage(spark, held, str(tmp_path)), name)
        counts.append(held.count())
        if name != "packing":
            assert held.columns == df.columns
    if empty:
        assert counts == [0] * 5
        return
    # rules drop null and empty texts; the text of three rows loses its line but in id 103, so an empty id 3 stays
    assert counts[0] == 27 and counts[1] == 27 and counts[2] == 22
    assert counts[3] >= 10 and counts[4] >= counts[3]
    assert set(held.columns) >= {"doc_id", "sequence_id", "offset"}


def test_run_is_the_stages(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.count() > 0 and sums.where("n > 2048 or n <> end").count() == 0


def test_held_out_rows_of_the_tables(spark):
    """On rows that nothing was learned from, toxic texts score higher than others, and predictions are better than
    calling no text toxic. The labels of held-out rows have no influence at all."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.toxicity(docs, labels)
    held = out.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("__score", "toxic").collect()
    hit, miss = ([r["__score"] for r in held if r.toxic == t] for t in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in hit for b in miss])
    assert auc > 0.7 and sum((r["__score"] >= toxicity.THRESHOLD) == bool(r.toxic) for r in held) > len(miss)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r["__score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {r.doc_id: r["__score"] for r in out.collect()}
