"""The queries of this package: one per operator, and the pipeline's tables in SQL where SQL can state them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import sql
from parley.llm.chat import format_chats, loss_text, parse, rows_to_records
from parley.llm.divergence import audit
from parley.llm.exact_dedup import exact_copies
from parley.llm.hard_negatives import mine
from parley.llm.language_id import identify
from parley.llm.licenses import scan_licenses
from parley.llm.mixing import mix
from parley.llm.near_dedup import near_duplicates
from parley.llm.packing import pack
from parley.llm.quality import decide, ledger
from parley.llm.quality_classifier import classify
from parley.llm.substring_dedup import remove_repeats
from parley.llm.token_counts import token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram with suffix sums, per source and over all."""
    return token_counts(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the current policy."""
    return decide(ledger(documents(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least document reachable over links of 85 % Jaccard."""
    return near_duplicates(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    return identify(documents(spark, sf_dir))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                        FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    made = format_chats(rows_to_records(rows.unionByName(hard)))
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select("conv_id", "layout", turns.alias("_t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("_l"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(F.array_join("_t", ""), 256).alias("turns_sha256"),
                       F.length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), "formatted_chars")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for it."""
    return exact_copies(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licence passages of all documents."""
    return scan_licenses(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that start earlier elsewhere."""
    cut = remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives within the score window of each anchor's five positives."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every document, learned from four fifths of the labels."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_mixing, op4_minhash_near_dedup, op5_language_id, op6_chat_formatting,
                            op7_exact_dedup, op8_license_scans, op9_substring_dedup, op10_packing, op11_source_divergence,
                            op12_hard_negatives, op13_quality_classifier)}
SQL: dict[str, str] = {
    "op2_quality_rules": sql.QUALITY, "op3_mixing": sql.MIXING, "op6_chat_formatting": sql.CHAT,
    "op7_exact_dedup": sql.EXACT, "op8_license_scans": sql.licenses(),
    "op11_source_divergence": sql.DIVERGENCE, "op12_hard_negatives": sql.HARD_NEGATIVES}
