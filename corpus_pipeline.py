"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of ``documents``; n_chars
follows the text where a stage changes it. Rows are judged on what the stage before kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, ngram_join, quality, repeats, sentencepieces
from tickloom.llm.common import aside, bloom, materialize, maybe_in, named, release, shared_dir
from tickloom.llm.queries import graded

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of an acceptable grade is at least one half stay."""
    model = quality.fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), "grade")
    flat, names = aside(docs)
    return named(quality.score(flat, model, pass_grade=1, text_col=f"f{names.index('text')}").where("keep"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return ngram_join.one_per_group(docs)


#: A passage of over 50 words that stands twice goes.
PASSAGE_WORDS = 51


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int | None = None) -> DataFrame:
    """Bytes under a repeated string of 400 bytes, or a repeated run of ``words`` words, go; documents that have no text left go with them.

    A character cut in two goes whole.
    """

    flat, names = aside(docs)
    doc_id, text, size = (f"f{names.index(c)}" for c in ("doc_id", "text", "n_chars"))
    own, schema = flat.columns, flat.schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([x.as_py().decode("utf-8", "ignore") for x in batch.column("kept")], pa.string())
            yield pa.RecordBatch.from_arrays([kept if c == text else batch.column(c) for c in own], names=own)

    out = repeats.remove_repeats(flat, id_col=doc_id, text_col=text, words=words)
    same = out.where(F.size("removed") == 0).select(*own)
    cut = out.where((F.size("removed") > 0) & (F.octet_length("kept") > 0)).select(*[F.lit(None).cast("string").alias(c) if c == text else c for c in own], "kept").mapInArrow(decoded, schema)
    return named(same.unionByName(cut.where(F.length(F.trim(text)) > 0).withColumn(size, F.length(text).cast(schema[size].dataType))), names)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As ``cut_repeats``, and passages of over 50 words go as well: many have fewer than 400 bytes."""
    return cut_repeats(spark, docs, sf_dir, PASSAGE_WORDS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and those whose text in ``documents`` did: an item that stands twice may have been cut from them in part."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = materialize(decontamination.matches(source, items).select(F.col("doc_id").alias("k")).where("k is not null").distinct(), "held")
    flat, names = aside(docs)
    split = maybe_in(flat.withColumn("k", F.col(f"f{names.index('doc_id')}")), bloom(held))  # only a few documents are shuffled
    rest = split.where("__maybe").drop("__maybe").join(held, "k", "left_anti")
    out = split.where(~F.col("__maybe")).select(*flat.columns).unionByName(rest.select(*flat.columns))
    return decontamination.decontaminate(named(out, names), items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids and the byte span of each piece."""
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_passages),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode),
]

#: A trained classifier and byte-exact repeats can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the shared folder, read again and then deleted, but for the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/tickloom-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}-{k}")
        if k:
            release(spark, docs)
        docs = spark.read.schema(out.schema).parquet(f"{base}-{k}")
    return docs
