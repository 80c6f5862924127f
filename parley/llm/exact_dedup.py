"""Exact dedup by skew-safe combining: local, per salt, then over the salts, on whole texts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.words import whole_rows
from parley.session import staged

HEAVY_SHARE = 1_000


def sha256_text(text: Column) -> Column:
    """Lower-case hex digest of a text's UTF-8 bytes."""
    return F.sha2(text, 256)


def _texts(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"))


def content_groups(texts: DataFrame, counts: DataFrame, total: int, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(digest, text, keep_id, group_size) of (doc_id, text, digest) rows: one row per distinct text.

    Three steps, each with the whole text as part of the key: inside a map task (partial
    aggregation), per (digest, salt), and over the salts of a digest. Only digests on more than
    1/``heavy_share`` of all rows have salts, one for each such share they hold; fewer than
    ``heavy_share`` digests can be that heavy, so their list has a bounded size and is broadcast.
    All other texts move once.
    """
    share = max(1, total // heavy_share)
    heavy = (counts.filter(F.col("n") > F.lit(total / heavy_share)).filter("n > 1")
             .select("digest", F.ceil(F.col("n") / F.lit(share)).cast("int").alias("salts")))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    merged = (texts.join(F.broadcast(heavy), "digest", "left").withColumn("salt", salt)
              .groupBy("digest", "salt", "text")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    winners = (merged.filter("salt is not null").groupBy("digest", "text")
               .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    return merged.filter("salt is null").drop("salt").unionByName(winners)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256_text) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after no change; null counts as empty. Of equal texts the row
    with the largest id stays. Different texts under one digest are different groups: a digest
    that stands for several texts is looked up by digest and text. Under SHA-256 no such digest is
    known, so their list, empty in practice, is broadcast; a weaker ``digest`` is for tests.

    A null id stays only where all rows of its group have null ids (keep_id is then null). Rows
    repeated with one id and text are all reported and all count in group_size. An empty table
    gives no rows; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col, digest)
    light = staged(texts.select("doc_id", "digest"))
    counts = light.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    groups = content_groups(texts, counts, light.count())
    per_digest = staged(groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    plain = light.join(per_digest.filter("texts = 1").drop("texts"), "digest")
    shared = per_digest.filter("texts > 1").select("digest")
    by_text = (texts.join(F.broadcast(shared), "digest")
               .join(groups.join(F.broadcast(shared), "digest"), ["digest", "text"])
               .select("digest", "doc_id", "keep_id", "group_size"))
    return (plain.select("digest", "doc_id", "keep_id", "group_size").unionByName(by_text)
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows repeated with one id and text one stays."""
    gone = exact_copies(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    row = F.col("row")
    keyed = whole_rows(docs).withColumn("id", row[id_col]).withColumn("digest", sha256_text(F.coalesce(row[text_col], F.lit(""))))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    return keyed.join(gone, same, "left_anti").dropDuplicates(["id", "digest"]).select("row.*")
