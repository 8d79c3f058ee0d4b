"""The queries op1 to op13 and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import centroids, chat_format, html_extract, line_dedup, media, mixing, near_dedup, packing, periodic, quality, sharding, suffix_dedup, toxicity
from tallyframe.llm.common import documents, materialize, utf8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir), n_shards=40)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("key", "doc_id")


def n_words(text: Column) -> Column:
    return F.size(quality.words_of(text)).cast("long")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", n_words(F.col("text")).alias("size"), "source", F.array("source").alias("members"))
    out = mixing.mix(docs)
    source = F.get("members", F.lit(0))
    sums = out.groupBy("members").agg(F.sum("size").alias("source_size")).withColumnRenamed("members", "m")  # one row per source
    target = F.when(source.isNull(), F.col("null_quota")).otherwise(F.try_element_at("quotas", source))
    return out.join(sums, F.col("members").eqNullSafe(F.col("m"))).select(F.col("key").alias("doc_id"), "size", "source_size", target.alias("target"), "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(documents(spark, sf_dir).select("doc_id", "text"))
    out = packing.pack(pieces.select("key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return out.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), media.padded(F.col("text")).alias("payload"))
    out = media.read(media.store(docs).drop("payload"))
    back = F.col("__payload")
    tail = F.substring(back, -64, 64)
    return out.select("doc_id", "n_bytes", F.octet_length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("__feature").alias("feature"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages are measured in bytes for what is removed; n_repeated_words counts the words in passages of more than
    50 words that start elsewhere too, which can be shorter in bytes or differ in white space."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    words = materialize(suffix_dedup.repeated_words(docs), "suffix-repeated").toDF("k", "h", "words")
    out = suffix_dedup.dedup_passages(docs)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    out = out.select("key", "text_hash", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    both = out.join(words, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    n_words = F.coalesce("words", F.lit(0).cast("long"))
    return both.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", n_words.alias("n_repeated_words"), (n_words > 0).cast("int").alias("repeats_passage"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels)
    score = F.col("__score")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir).select("doc_id", "text"), trusted(spark, sf_dir))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in names])


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = chat_format.read_back(chat_format.format_conversations(given.unionByName(more)))
    return out.withColumnRenamed("key", "conv_id")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, final = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row per centroid
    within, total = {r.cluster: r.s for r in sums}, sum(r.s or 0 for r in sums)
    whole = lambda n: F.lit(n if n is not None and n < 2**63 else None).cast("long")
    inertia = F.lit(None).cast("long")
    for c, s in within.items():
        inertia = F.when(F.col("cluster") == c, whole(s)).otherwise(inertia)
    return out.select(F.col("key").alias("vec_id"), "cluster", "distance", inertia.alias("cluster_inertia"), whole(total).alias("inertia"), F.get(F.array(*map(F.lit, digests or [""])), F.col("cluster")).alias("centroid_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = documents(spark, sf_dir).select("doc_id", "text", h.alias("h"))
    # of every tenth hash, the end of the text is made periodic
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, quality.words_of(F.col("text"))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    docs = docs.withColumns({"n": n, "a": (g % F.nullif(n, F.lit(0))).cast("int"), "parts": (3 + g % 8).cast("int")}).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("parts"))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    out = periodic.periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text")))
    best, runs = periodic.strongest(F.col("runs")), F.col("runs")
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.select("key", "runs", best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    start, length, period = (F.col(f"best.{c}") for c in ("start", "length", "period"))
    return out.select(F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_near_dedup, op4_mixing, op5_packing, op6_media, op7_html_extraction, op8_suffix_dedup, op9_toxicity, op10_quality_rules, op11_chat_formatting, op12_centroid_clustering, op13_periodic_runs, pipeline)}

#: DuckDB: 'A' to 'Z' alone go to lower case; chr(9) to chr(13) and the blank are white space.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_WHITE}), {_LOWER}) AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.*, f.k IS NOT NULL AND a.doc_id <> f.keeper AS gone FROM keyed a LEFT JOIN frequent f ON a.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

#: Each turn has "### ", ":", two line feeds and "</turn>" around its guarded role and text.
OP11 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, list_sum([length(x) + (length(x) - length(replace(x, '\', ''))) + (length(x) - length(replace(x, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(x, '#+'), lambda y: length(y) - 1)), 0) FOR x IN [role, text]])
    + (length(role) - length(replace(role, chr(10), ''))) + 14 AS chars
  FROM given
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: Nearest of all centroids, by every one's distance.
_NEAREST = """
a{i} AS MATERIALIZED (
  SELECT id, min(struct_pack(d := d, c := c)) AS near FROM (
    SELECT q.id, c.c, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM q, c{i} c
  ) GROUP BY id
)"""
_MOVED = """
m{i} AS MATERIALIZED (
  SELECT c, list(x ORDER BY pos) AS v FROM (
    SELECT c, pos, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT near.c AS c, unnest(v) AS x, unnest(range(64)) AS pos FROM q JOIN a{i} USING (id)) GROUP BY c, pos
    )
  ) GROUP BY c
), c{j} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)"""
OP12 = """
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM q ORDER BY sha256('1:' || vec_id), v LIMIT 16),""" + ",".join(
    _NEAREST.format(i=i) + ("," + _MOVED.format(i=i, j=i + 1) if i < 3 else "") for i in range(4)
) + """
SELECT vec_id, CAST(near.c AS INT) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM q JOIN a3 USING (id) JOIN c3 ON c3.c = near.c
"""

ORACLE = {"op12_centroid_clustering": OP12, "op11_chat_formatting": OP11, "op2_line_dedup": OP2, "op3_near_dedup": OP3}
