"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, lm_window, ngram_join, quality, repeats, sentencepieces, sharding, token_counts, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_documents(spark, sf_dir))


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(_documents(spark, sf_dir).select("doc_id", "text"), path, decoded="decoded", columns=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("span_end", -1).cast("long").alias("n_bytes"),
    )


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["begin"]))
    return out.select("doc_id", (F.octet_length("kept") + n_removed).cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).alias("has_repeats"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


TOXIC_CHAIN = ["low_quality", "toxic"]


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = _labels(spark, sf_dir).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    links = toxicity.fit(docs, labels, TOXIC_CHAIN)
    return toxicity.score(docs, links, TOXIC_CHAIN, columns=["doc_id"])


def graded(labels: DataFrame) -> DataFrame:
    """Three grades: 0 rejected, 1 acceptable but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic")).alias("grade"))


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, graded(_labels(spark, sf_dir)), "grade")
    return quality.score(docs, model, pass_grade=1, columns=["doc_id"])


SHARD_BYTES = 1 << 20


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir).select("doc_id", "text"), SHARD_BYTES)


ORACLES["op6_sharding"] = f"""
WITH items AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), levels AS (SELECT range::INT AS depth FROM range(0, 61)
), buckets AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM items, levels GROUP BY ALL
), fitting AS (SELECT * FROM buckets WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1
), first_fit AS (
  SELECT i.doc_id, i.n_bytes, min_by(f, f.depth) AS f FROM items i JOIN fitting f ON f.prefix = i.h >> (60 - f.depth) GROUP BY ALL
)
SELECT doc_id, n_bytes, 's' || CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(f.prefix), f.depth, '0') END AS shard_id,
       f.depth AS depth, f.shard_bytes AS shard_bytes, f.shard_rows AS shard_rows, f.shard_bytes > {SHARD_BYTES} AS oversized
FROM first_fit
"""


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.matches(_documents(spark, sf_dir), items)


_SHINGLES = """list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"""
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, len(s)::BIGINT AS n_item, unnest(s) AS s FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS node, b AS other FROM p UNION SELECT r.node, p.b FROM reach r JOIN p ON p.a = r.other),
low AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
n AS (SELECT a AS node, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.node = vec_id LEFT JOIN n ON n.node = vec_id
"""


@_query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return lm_window.score(docs, lm_window.fit(docs), columns=["doc_id"])


ORACLES["op1_ngram_join"] = f"""
WITH RECURSIVE sets AS MATERIALIZED (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents)),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
low AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN low ON low.node = doc_id
"""
