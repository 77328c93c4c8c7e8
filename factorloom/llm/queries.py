"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, hard_negatives, jaccard_join, language_model, line_dedup, mixing, neighbours, packing, sharding, token_counts, toxicity, variants

SHARDS = [f"shard-{i:02d}" for i in range(64)]
SLOTS = 4099


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, boundary-crossing tokens counted where they begin."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), rule="first")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False, words=700_000).drop("ids")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of each document, with the length of its text."""
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs.select("doc_id", "source", F.char_length("text").cast("long").alias("n_text")), SHARDS, slots=SLOTS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net, extra=["doc_id"])
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, least=1).drop("kept_text")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), least=7, least_count=2, damage=31)
    return variants.group_variants(words, factor=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), every=100, positives=5, negatives=10, low=30, high=90)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_model": op10_language_model,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL = {
    "op2_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) AS name, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s
), rounds AS (
  -- each round: sources that stopped keep twice their words, the others share what is left
  SELECT 0 AS k, source, source_size, weight, false AS stopped FROM w
  UNION ALL
  SELECT k + 1, source, source_size, weight, stopped OR
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (stopped) OVER (), 0)) / nullif(sum(weight) FILTER (NOT stopped) OVER (), 0) * weight >= 2 * source_size
  FROM rounds WHERE k < 40
), t AS (
  SELECT source, source_size, CASE WHEN stopped THEN 2.0::DOUBLE * source_size ELSE
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (stopped) OVER (), 0)) / sum(weight) FILTER (NOT stopped) OVER () * weight END AS target
  FROM rounds WHERE k = 40
), e AS (
  SELECT d.*, t.source_size, t.target,
    least(2.0::DOUBLE, coalesce(t.target / nullif(t.source_size, 0), 0)) AS expected,
    (('0x' || substr(md5('7:' || name), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS p FROM e
), q AS (
  SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS lack,
    CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM r
), x AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle FROM q
)
SELECT doc_id, size, source_size, target,
  CAST((sure + CASE WHEN rank IS NOT NULL AND middle <= lack THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(sure + CASE WHEN rank IS NOT NULL AND middle <= lack THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM x""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d""",
    "op7_sharding": f"""
WITH d AS (
  SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_text,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {SLOTS} AS INT) AS slot FROM documents
)
SELECT doc_id, source, n_text, slot, 'shard-' || lpad(CAST({sharding.lookup_table(SHARDS, SLOTS)}[slot + 1] AS VARCHAR), 2, '0') AS shard FROM d""",
    "op9_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'no key ' || coalesce(text, '')) AS document, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, document, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), many AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT document) >= 10
), o AS (
  SELECT k.*, many.key IS NOT NULL AS gone FROM k LEFT JOIN many USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM o GROUP BY rid, doc_id""",
    "op11_spelling_variants": r"""
WITH RECURSIVE steps AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents
), keyed AS (
  SELECT doc, run, count(*) AS times, hex(encode(doc || ':' || run)) AS code FROM runs GROUP BY doc, run
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(code), 2), lambda j: CAST(('0x' || substr(code, j, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM keyed, crc
), damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM words, unnest(range(1, length(word) + 1)) u(i)
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b
), best AS (
  SELECT word, CAST(count(*) AS BIGINT) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL""",
    "op12_hard_negatives": r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, o.uid AS o, o.vec_id AS id, a.label = o.label AS alike, CAST(list_dot_product(a.x, o.x) AS BIGINT) AS score
  FROM v a JOIN v o ON a.uid <> o.uid AND len(a.x) = len(o.x) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, o) <= 5
), n AS (
  SELECT p.a, p.o, p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.o ORDER BY s.score DESC, s.id, s.o) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
