"""Token counts: an exact histogram of encoded lengths that answers every context limit."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tokens import encoder
from parley.operators.scans import RunSum, block_of, scan
from parley.session import staged

BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and n_tokens of every row; a null text has 0 tokens. Texts are read whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            sizes = [len(ids) // 4 for at in range(0, batch.num_rows, 256)
                     for ids in enc.encode(batch.column(0).slice(at, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.asarray(sizes, np.int64))],
                                             [*keys, "n_tokens"])

    chosen = docs.select(F.col(text_col).alias("_text"), *keys)
    schema = ", ".join([*(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys), "n_tokens long"])
    return chosen.mapInArrow(run, schema)


def histogram(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_tokens, n_docs): combined in the map tasks, at most one row per length and key after."""
    return lengths.groupBy(*keys, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, keys: list[str]) -> DataFrame:
    """For each length L of the histogram what a context limit of L keeps.

    docs_within / tokens_within: documents of at most L tokens; docs_over: longer ones;
    truncated_tokens: sum of min(length, L) over all documents; share_within: docs_within over all
    documents, the quantile that L is. Sums run block by block, so one key's lengths need no
    single task.
    """
    n, size = F.col("n_docs"), F.col("n_tokens")
    counted = scan(hist, keys, ["n_tokens"], block_of(size, BLOCK),
                   docs_within=RunSum(n), tokens_within=RunSum(n * size))
    totals = hist.groupBy(*keys).agg(F.sum("n_docs").alias("_docs"), F.sum(n * size).alias("_tokens"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = counted.alias("c").join(totals.alias("t"), same, "inner")
    over = F.col("_docs") - F.col("docs_within")
    return joined.select(
        *[F.col(f"c.{k}") for k in keys], "n_tokens", "n_docs", "docs_within", "tokens_within", over.alias("docs_over"),
        (F.col("_tokens") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + over * size).alias("truncated_tokens"),
        (F.col("docs_within") / F.col("_docs")).alias("share_within"))


def at_limit(sums: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per key the totals for one context limit that need not be a length of the histogram."""
    under = F.col("n_tokens") <= limit
    return sums.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(under, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.sum(F.when(~under, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")).alias("truncated_tokens"))


def quantile(sums: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Per key the least length with at least a share ``q`` of the documents within it."""
    hit: Column = F.col("share_within") >= q
    return sums.groupBy(*keys).agg(F.min(F.when(hit, F.col("n_tokens"))).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", by: str = "source",
                 text_col: str = "text") -> DataFrame:
    """Histogram with suffix sums per value of ``by`` and, with scope 'all', over all documents.

    Columns: scope ('all' or 'group'), group, and those of ``suffix_sums``. A null text counts as a
    document of 0 tokens, a null group as a group of its own, repeated rows as often as they
    stand; an empty table gives no rows; other columns are ignored.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null"))
    lengths = encoded_lengths(docs.select(F.col(text_col), named.alias("key")), tokenizer, ["key"], text_col)
    both = histogram(lengths, ["key"]).withColumn("key", F.explode(F.array("key", F.lit("all"))))
    sums = suffix_sums(staged(both.groupBy("key", "n_tokens").agg(F.sum("n_docs").alias("n_docs"))), ["key"])
    scope = F.when(F.col("key") == "all", "all").otherwise("group")
    group = F.when(F.col("key").startswith("="), F.substring("key", 2, 2**30))
    return sums.select(scope.alias("scope"), group.alias("group"), *sums.columns[1:])
