"""Lookups from a big, possibly skewed side into a table with one row per key."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_lookup(big: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str],
                 how: str = "inner", spread: int | None = None) -> DataFrame:
    """Join occurrences to a per-key table.

    By default a plain join: Spark broadcasts the small side when its measured size allows, and
    otherwise cuts partitions that it measures as skewed into as many tasks as they need. With
    ``spread`` every key is spread over that many tasks beforehand, for plans where Spark can't cut
    (a grouping by the same key right behind): the salt is a hash of row identity (``salt_by``), so
    a retried task salts the same way, and the small side is repeated ``spread`` times.
    """
    if spread is None:
        return big.join(small, list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(spread)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


#: Bytes, about, of a table that ``sent`` sends to all tasks.
SENT = 16 << 20


def sent(table: DataFrame) -> DataFrame:
    """A written table of keys, to be sent to all tasks where its measured size allows; Spark joins a larger one as it sees fit."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    return F.broadcast(table) if size <= SENT else table
