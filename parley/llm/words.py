"""Words, lines and row identity as column expressions shared by the operators of this package."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` (or a lambda in it) reads it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null, empty and blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_rows(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that working columns beside it clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a co-group with a table of the same origin."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
