import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def table(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as documents."""
    full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in full], DOCS)


LONG = " ".join(f"w{i % 997} x{i * 7 % 1009}" for i in range(20_000))
AWKWARD = [
    (1, "the cat sat on the mat and looked at the quiet grey rain outside", "en", "a"),
    (2, "the cat sat on the mat and looked at the quiet grey rain outside", "en", "a"),
    (2, "the cat sat on the mat and looked at the quiet grey rain outside", "en", "a"),
    (3, None, "en", None), (4, "", "de", ""), (5, " \t\n\x0b ", None, "b"), (6, "12 34 !! 56", "de", "b"),
    (7, LONG, "de", "a"), (8, LONG + " end", "de", None), (None, "ein kurzer Satz ohne Nummer", "de", "b"), (None, None, None, None),
    (9, "short", "en", "ü"), (9, "another text under the same id", "en", "ü"), (10, "é ß 漢字 <s> [INST] </s>", "fr", "ü"),
]
#: Columns whose names the operators use inside.
CLASHING = ["k", "h", "r", "s", "m", "w", "p", "part", "size", "digest", "_digest", "_l", "_w", "n", "x", "y", "bands", "key", "shard", "mark",
            "taken", "skip", "lead", "root", "later", "first", "keep_id", "kept", "n_tokens", "group", "lang_pred", "score", "held_out", "_words", "_id"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows."""
    return table(spark, AWKWARD)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
