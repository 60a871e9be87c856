"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bpe, crosspolytope, hardneg, langid, linededup, lm, mixing, phrases, quality, rules, simhash, tokenfile, topk
from evenkeel.llm.common import fold, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "line_count", "lines_dropped", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


@query
def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        definition = f.read()
    path = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, definition)
    return tokenfile.digests(tokenfile.read(spark, path))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True, chunks=500_000))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = quality.score(docs, quality.fit(docs, labels.where(fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, docs.where(fold("doc_id", 5) != 1))
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


@query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


ORACLE["op9_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0 * source_size AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM s),
r AS (
  SELECT *, cap / weight AS ratio, 1.5 * (SELECT sum(source_size) FROM s) AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM w),
l AS (SELECT (budget - filled) / opened AS level FROM r WHERE (budget - filled) / opened <= ratio ORDER BY ratio LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM l), cap))::DOUBLE AS target FROM w),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0 AS middle
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND size > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
ORACLE["op12_phrase_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, j, unnest(range(1, len(w) - j + 2)) AS i FROM w, range(1, 6) t(j)),
f AS (
  SELECT lang, j, array_to_string(w[i:i + j - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, j, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE j > 1),
s AS (SELECT lang, j, a, w, o, unnest(range(1, j - o + 2)) AS i FROM c, range(2, 5) t(o) WHERE o < j),
i AS (SELECT DISTINCT lang, array_to_string(w[i:i + o - 1], ' ') AS phrase, a FROM s),
k AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
u AS (
  SELECT lang, phrase, a, x, array_to_string(w[1:x], ' ') AS first, array_to_string(w[x + 1:j], ' ') AS rest
  FROM (SELECT *, unnest(range(1, j)) AS x FROM k)),
v AS (
  SELECT u.lang, u.phrase, u.a, x, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.first JOIN f r ON r.lang = u.lang AND r.phrase = u.rest
  JOIN t ON t.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) AS cut FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM b WHERE cut = 1)
SELECT lang, place::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE place <= 2000
"""

_WHOLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT uid, vec_id, {label} AS label, x FROM v),
s AS (
  SELECT q.uid AS q, q.vec_id AS query_id, q.label AS query_label, c.vec_id, c.label,
         list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM c q JOIN c ON q.uid <> c.uid AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)"""

ORACLE["op11_exact_top_k"] = _WHOLE.format(scale=1024, label="label") + """
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

ORACLE["op13_hard_negatives"] = _WHOLE.format(
    scale=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") + """,
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS place
                 FROM s WHERE label = query_label) WHERE place <= 5),
n AS (
  SELECT p.query_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.q, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.q = p.q AND s.label <> s.query_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT query_id AS anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
