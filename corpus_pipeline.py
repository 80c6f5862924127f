"""An English training corpus from raw documents: language, exact and near copies, mix, packed sequences."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.exact_dedup import drop_copies
from parley.llm.language_id import known_language
from parley.llm.mixing import mixed_rows
from parley.llm.near_dedup import keep_one_of_each
from parley.llm.packing import pack
from parley.session import staged

#: Languages of the corpus, as the labels name them.
LANGUAGES = ["en"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in the corpus's languages, whatever their label; texts without a letter and null texts go."""
    return known_language(docs, languages=LANGUAGES)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest id."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 4096."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenising and the trained classifier have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda d, stage: staged(stage[1](spark, d, sf_dir)), STAGES, docs).withColumn(
        "length", (F.length("ids") / 4).cast("long"))
