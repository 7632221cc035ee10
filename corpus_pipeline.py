"""A corpus pipeline of five stages, each on all that the one before has kept. Part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
any further ones that docs has. Rows with null, empty or wordless texts are scored by the models' biases alone, are no
duplicates of each other, have no words to mix, so that the mix doesn't take them, and would encode to no ids. Rows with
a null id are judged like others and are no duplicates. Rows that repeat an id are one document after near_duplicates.
Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, minhash, mixing, quality, toxicity
from tessella.llm.common import written
from tessella.llm.entries import tokenizer_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose probability of the category toxic is under 0.5."""
    return toxicity.kept(docs, _labels(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that score 0.5 or more; learns from the labels of the rows that are left."""
    return quality.kept(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part of half or more of its words counts as a whole."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix repeats are numbered as copies, each drawn on its own."""
    return bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs


#: Learnt models and hashed segmentations aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None
