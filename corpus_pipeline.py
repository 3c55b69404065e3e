"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbside.llm import decontam, packing, quality, simhash, toxicity
from kerbside.llm.store import ship, stash

TOXIC = 0.7


def by_position(stage):
    """Runs a filtering stage on columns d0, d1, ... so that no name of documents can clash.

    The stage gets the names of doc_id, text and n_chars as well.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        inner = [f"d{i}" for i in range(len(docs.columns))]
        known = dict(zip(docs.columns, inner))
        out = stage(spark, docs.toDF(*inner), sf_dir, *[known[c] for c in ("doc_id", "text", "n_chars")])
        return out.select(*inner).toDF(*docs.columns)

    return run


@by_position
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, i: str, text: str, n_chars: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones selects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(i), "quality")
    return quality.resample(docs, quality.fit(docs, labels, i, text), id_col=i, text_col=text).where("selected")


@by_position
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, i: str, text: str, n_chars: str) -> DataFrame:
    """Documents below the toxicity score of 0.7, learned from all labels of the documents left."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(i), "toxic")
    model = toxicity.train(docs, labels, lambda x: x.isNull(), i, text)
    return toxicity.score(docs, model, text).where(F.col("score") < TOXIC)


@by_position
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, i: str, text: str, n_chars: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.keep_first(docs, width=3, distance=3, id_col=i, text_col=text)


@by_position
def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str, i: str, text: str, n_chars: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark, text_col=text, length_col=n_chars)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row per piece, with its token ids."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmarks),
    ("packing", packed),
]

# models, components and tokenizers: SQL can't express the stages; tests/llm compares them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
