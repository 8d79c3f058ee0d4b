"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted and raw text.

DataFrame functions only. The raw multinomial counts the hashed words and word pairs of every document, the
trusted one those of a bounded sample of documents known as good. A document's score is the mean of
log(trusted / raw) over its words and pairs; documents under a fixed threshold for their length are rejected, on any machine alike.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import WHITE, free_names, other_columns

N_BUCKETS = 1 << 14
#: At most so many trusted documents are used (the least hashes of their ids).
MAX_TRUSTED = 20_000
SMOOTHING = 1.0
SHRINK = 16.0
#: A document stays if its score is at least THRESHOLD - SLACK / sqrt(words): means over few words scatter more.
THRESHOLD = -0.08
SLACK = 0.3
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: The columns that quality() adds.
MADE = ("__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed", "__score", "__kept")


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(WHITE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it and wherever the optimizer moves
    the expression."""
    return F.transform(F.array(value), body)[0]


def hashes_of(text: Column) -> Column:
    """The 64-bit hashes of the words of a text in order."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def pairs_of(hashes: Column) -> Column:
    """The hashes of the pairs of words in a row."""
    return F.transform(_starts(hashes, 2), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)))


def _starts(hashes: Column, width: int) -> Column:
    """0 up to the last place where so many words begin; none in shorter texts."""
    n = F.size(hashes)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def repeated_words(hashes: Column, pairs: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of width words that are found twice or more (long). A window is hashed by its
    pairs, and its last word if width is odd."""
    parts = lambda i: [F.get(pairs, i + k) for k in range(0, width - 1, 2)] + ([F.get(hashes, i + width - 1)] if width % 2 else [])
    windows = F.transform(_starts(hashes, width), lambda i: F.xxhash64(*parts(i)))

    def covered(places: Column) -> Column:
        # each place covers width words, less those that the place before it covers
        fresh = F.transform(places, lambda i, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), i - F.get(places, F.greatest(k - 1, F.lit(0))))))
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(order: Column) -> Column:
        # windows in order of hash and place; a window repeats if a neighbour has the same hash
        before = lambda x, k: (k > 0) & (F.get(order, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])
        after = lambda x, k: F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, k: after(x, k) | before(x, k)), lambda x: x["i"]))

    def of(w: Column) -> Column:
        order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(order, lambda o: let(places(o), covered))).otherwise(F.lit(0).cast("long"))

    return let(windows, of)


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text", n_buckets: int = N_BUCKETS, max_trusted: int = MAX_TRUSTED, smoothing: float = SMOOTHING, shrink: float = SHRINK) -> list[float]:
    """log(trusted / raw) of each bucket. Counts cover all of docs; they are summed within tasks before the shuffle.

    The raw multinomial has smoothing added to each bucket. The trusted one is drawn towards the raw one by shrink
    grams in each bucket: what trusted text was too short to show says little. Without trusted documents or words
    every ratio is 0."""
    ids = trusted_ids.select(F.col(key).alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_trusted)
    flagged = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("__id"), "left")
    hashes = let(hashes_of(F.col("text")), lambda wh: F.concat(wh, pairs_of(wh)))
    grams = flagged.select(F.col("__id").isNotNull().cast("long").alias("good"), F.explode(hashes).alias("gram"))
    counts = {r.bucket: (r.raw, r.good) for r in grams.groupBy(F.pmod("gram", F.lit(n_buckets)).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()}
    raw, good = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not good:
        return [0.0] * n_buckets
    own = [(counts.get(b, (0, 0))[0] + smoothing) / (raw + smoothing * n_buckets) for b in range(n_buckets)]
    return [math.log((counts.get(b, (0, 0))[1] + shrink) / (good * own[b] + shrink)) for b in range(n_buckets)]


def quality(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text", n_buckets: int = N_BUCKETS, max_trusted: int = MAX_TRUSTED, smoothing: float = SMOOTHING, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """Every row and column of docs, with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words,
    __base_failed, __score and __kept.

    Null and empty texts have no words: all counts are 0, they fail the base rules and their score is null. Rows that
    repeat an id are scored each by its own text, rows without an id too. Very long texts are read whole. An empty
    table gives no rows. Columns of docs named like those added are replaced, all others stay, whatever their names.
    trusted_ids: a table with key; ids not in docs don't matter.
    """
    ratios = log_ratios(docs, trusted_ids, key, text, n_buckets, max_trusted, smoothing)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to a constant, of a fixed size
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    zero = F.lit(0.0)

    def verdict(wh: Column) -> Column:
        return let(pairs_of(wh), lambda pairs: counted(wh, pairs))

    def counted(wh: Column, pairs: Column) -> Column:
        n = F.size(wh).cast("long")
        ratios_of = lambda grams: F.aggregate(grams, zero, lambda a, h: a + F.get(table, F.pmod(h, F.lit(n_buckets)).cast("int")))
        score = (ratios_of(wh) + ratios_of(pairs)) / F.when(n > 0, 2 * n - 1)
        return let(
            F.struct(n.alias("n_words"), repeated_words(wh, pairs).alias("n_repeat_words"), score.alias("score")),
            lambda v: F.struct(v["n_words"].alias("n_words"), v["n_repeat_words"].alias("n_repeat_words"), v["score"].alias("score"), ((v["n_words"] < 10) | (100 * v["n_repeat_words"] > 20 * v["n_words"])).alias("failed")),
        )

    v = let(hashes_of(F.col(text)), verdict)
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    (held,) = free_names(docs, "__v")
    got = lambda name: F.col(f"{held}.{name}")
    fits = F.coalesce(got("score") >= threshold - slack / F.sqrt(got("n_words")), F.lit(True))
    return docs.withColumn(held, v).select(
        *other_columns(docs, *MADE),
        got("n_words").alias("__n_words"),
        F.char_length(F.regexp_replace(t, "[ \\t-\\r]+", "")).cast("long").alias("__word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("__n_symbols"),
        dup_lines.alias("__n_dup_lines"),
        got("n_repeat_words").alias("__n_repeat_words"),
        got("failed").alias("__base_failed"),
        got("score").alias("__score"),
        (~got("failed") & fits).alias("__kept"),
    )
