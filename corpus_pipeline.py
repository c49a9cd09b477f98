"""The corpus pipeline: documents in, cleaned and packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocktake.llm import latent_decontamination, mixture_packing, quality_knn, simhash_pivots, toxicity_fm
from stocktake.llm.common import load, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return toxicity_fm.accepted(docs, load(spark, sf_dir, "labels"), threshold=0.3)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    return quality_knn.accepted(docs, load(spark, sf_dir, "labels"), threshold=0.7)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the smallest id."""
    return simhash_pivots.keep_one(docs, words=4, max_bits=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return latent_decontamination.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 4096 tokens."""
    import public_tokenizers
    return mixture_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("simhash_neardup", keep_one_of_group),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither the learned scores nor the tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each over all that its predecessor kept."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
