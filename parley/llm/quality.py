"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations read bits."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.words import SPACES, WORD, let, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A name and a SQL condition on the measurements that is true where a document fails."""

    name: str
    fails: str


#: Bit k of ``fail_bits`` belongs to rule k.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that decide.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "duplicate_lines"),
    "v3": tuple(r.name for r in RULES),
}
CURRENT = "v3"


def repeat_words(w: Column, n: int = 3) -> Column:
    """Words of ``w`` inside an n-word window that occurs at least twice in ``w``.

    Windows are hashed, hashes sorted with their positions, equal neighbours marked, and the
    union of the marked windows is measured from one marked position to the next.
    """
    def by_hash(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(
            F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)), x["i"])),
            lambda i: i.isNotNull())), lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))),
                F.lit(0), lambda a, x: a + x)))

    def of(a: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(n)]))
        return F.when(F.size(a) < n, 0).otherwise(
            let(h, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(by_hash(x))))

    return let(w, of)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its measurements as long columns, from whole texts; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.length(F.regexp_replace(text, SPACES, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("rep")))
    return (docs.withColumn("_l", of_lines).withColumn("_w", of_words)
            .withColumns({
                "n_words": F.col("_w.n").cast("long"), "word_chars": bare.cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_lines": F.col("_l.n").cast("long"), "n_dup_lines": F.col("_l.dup").cast("long"),
                "n_repeat_words": F.col("_w.rep").cast("long")})
            .drop("_l", "_w"))


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules."""
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: its id, the measurements and ``fail_bits`` (long), one bit per rule.

    A null or empty text has no words and fails as too short; repeated rows have a row each; an
    empty table gives none; other columns are not carried, so clashing names do no harm. Nothing
    is shuffled.
    """
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    measured = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").drop("_text")
    return measured.withColumn("fail_bits", bits)


def decide(book: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES,
           policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A ledger with base_failed and kept under one policy; no text is read again."""
    bits = F.col("fail_bits")
    base = bits.bitwiseAND(F.lit(mask(BASE, rules))) != 0
    kept = ~base & (bits.bitwiseAND(F.lit(mask(policies[policy], rules))) == 0)
    return book.withColumn("base_failed", base).withColumn("kept", kept)


def ablations(book: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES,
              policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per rule of a policy: documents that fail it, fail it alone, and are kept without it.

    One pass counts the documents of each bit pattern, of which there are at most 2 ** rules; all
    questions are then bitwise sums over those counts.
    """
    whole = mask(policies[policy], rules)
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n], rules)).cast("long").alias("bit")) for n in policies[policy]])
    counts = (book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_r", F.explode(names)).select("bits", "n", "_r.rule", "_r.bit"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.lit(whole).cast("long") - F.col("bit")) == 0

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return counts.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & others).alias("n_failed_alone"),
                                      total(others).alias("n_kept_without"))
