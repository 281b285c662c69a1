"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, capfilter, licenses, linededup, minhash, mixing, pii, quality, tokenfile, toxicity
from .common import read, shared_dir


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its lines, those that went, and a digest of what is left of the text.  Exact repeats go at every length but 0."""
    found = linededup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tarnwork-{uuid.uuid4().hex}/tokens"
    tokenfile.write(read(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return tokenfile.read(spark, path)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=2)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    kinds = [k.name for k in pii.KINDS if k.base]
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.filter("pii", lambda x: x["ord"] < len(kinds))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("matches")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_mixing, op4_embedding_neardup, op5_line_dedup, op6_token_file, op7_minhash, op8_pii, op9_licenses, op10_byte_bpe)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_STOPS = "'" + "','".join(quality.STOP_WORDS) + "'"

ORACLES = {
    "op2_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words,
    len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS n_ellipses,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
    len(regexp_extract_all(t, '!!')) AS n_shouts, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1 AND n_ellipses / n_lines <= 0.3 AND n_bullets / n_lines <= 0.9
  AND n_dup_lines / n_lines <= 0.5 AND n_stop_words >= 2 AND n_upper / word_chars <= 0.4 AND n_shouts / n_words <= 0.2 AS kept
FROM m
""",
    "op3_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, round(least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / weight) * weight, cap)), 6) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (SELECT *, target - whole * source_size AS rest FROM g
), u AS (
  SELECT d.doc_id, d.size, d.h, r.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, least(2, whole + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN 1
  WHEN upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM u
""",
    "op4_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), c(id, low) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.id WHERE c.low < l.b
), m AS (SELECT id, min(low) AS component_id FROM c GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = vec_id
""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL
), t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM l
), d AS (SELECT s, min({'d': doc_id, 'n': no}) AS first FROM t WHERE s <> '' GROUP BY s
), v AS (SELECT s, first, i, s[:i - 1] || s[i + 1:] AS less FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM d WHERE len(s) >= 20)
), p AS (
  SELECT a.first AS x, b.first AS y FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.first < b.first
  UNION SELECT least(a.first, b.first), greatest(a.first, b.first) FROM v a JOIN d b ON a.less = b.s AND len(b.s) >= 20
), g AS (SELECT DISTINCT y FROM p
), k AS (
  SELECT t.doc_id, no, raw, t.s <> '' AND (first <> {'d': t.doc_id, 'n': no} OR y IS NOT NULL) AS gone FROM t LEFT JOIN d ON d.s = t.s LEFT JOIN g ON y = {'d': t.doc_id, 'n': no}
), r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS left_over FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS text_sha256 FROM documents LEFT JOIN r USING (doc_id)
""",
    "op7_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS sh FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), c(id, low) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT p.b, c.low FROM c JOIN p ON p.a = c.id WHERE c.low < p.b
), m AS (SELECT id, min(low) AS component_id FROM c GROUP BY id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON m.id = doc_id
""",
}
