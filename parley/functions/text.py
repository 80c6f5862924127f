"""Token and text rules as column expressions (all JVM-side)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation sets and word lists that decide results.
SENTENCE_END = r'[.!?…]$|[.!?]"$'
TRAILING_PUNCT = r"""^(.*?)([.,;:!?"\)\]}']+\.{0,3})$"""
POSSESSIVE = r"^(.+)(['’]s)$"
SYMBOLS_ONLY = r"(?U)^[\W♪♫\[\]()\-–—.…]+$"
FILLERS = [
    "hmm", "hm", "hmmm", "mm", "mmm", "mhm", "mmhm", "mmhmm", "mhmm",
    "uh", "uhh", "uhhuh", "um", "umm", "er", "err", "oh", "ohh",
    "ah", "ahh", "huh", "yeah", "yep", "yup", "right", "ok", "okay",
]
PHRASE_STOP = [
    "the", "a", "an", "my", "your", "his", "her", "their", "our", "its", "that",
    "this", "these", "those", "said", "says", "and", "but", "or", "to", "of", "in",
    "on", "at", "with", "is", "was", "are", "were", "it", "he", "she", "they", "you",
    "i", "we", "me", "him", "them", "there", "here", "what", "who", "when", "then",
    "so", "no", "not", "do", "does", "did", "had", "have", "for", "from", "be",
    "like", "just", "really", "very", "actually", "exactly", "okay", "well",
    "yeah", "oh", "um", "uh", "now", "also", "maybe",
]
NOT_A_WORLD = ["", "original", "made up", "made-up", "none", "unknown", "n/a"]
NONE_MARKERS = [
    "made up", "madeup", "make believe", "makebelieve", "original",
    "invent", "imaginar", "fiction", "no world", "not a real",
    "not real", "no known", "none", "unknown", "n a", "generic",
]
CUES = {
    "START": [
        r"\bstart the story\b", r"\blet'?s start\b", r"\bsay the words\b",
        r"\bonce upon a\b", r"\bhelp me tell (it|the story)\b",
    ],
    "END": [r"\bthe end\b", r"\bthat'?s the end\b"],
    "TRANSITION": [
        r"\b(a )?(different|another|new|last|next) (kind of )?stor(y|ies)\b",
        r"\bno more .{0,20}\bstor(y|ies)\b",
        r"\bwhat should we (do|tell) .{0,20}\bstor(y|ies)\b",
        r"\bdo you want (a|an)other\b",
    ],
    "WINDDOWN": [r"\bi see trees of green\b", r"\bred roses,? too\b", r"\bwhat a wonderful world\b"],
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Trim every Unicode space on both sides, not only blanks."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def clean(col) -> Column:
    """Bare lower-case letters of a token, without edge punctuation and possessive.

    Most tokens are letters alone and need none of the replacements.
    """
    t = F.lower(strip(col))
    t = F.regexp_replace(t, r"[^a-z'’]+$", "")
    t = F.regexp_replace(t, r"^[^a-z'’]+", "")
    t = F.regexp_replace(t, r"['’]s?$", "")
    return F.when(_c(col).rlike(r"^[A-Za-z]+\z"), F.lower(_c(col))).otherwise(F.regexp_replace(t, r"[^a-z]", ""))


def letters(col) -> Column:
    return F.regexp_replace(F.lower(_c(col)), r"[^a-z]", "")


def is_capitalized(col) -> Column:
    """The first letter is upper case."""
    return _c(col).rlike(r"^[^\p{L}]*\p{Lu}")


def ends_sentence(col) -> Column:
    return strip(col).rlike(SENTENCE_END)


def tokens(col) -> Column:
    """Whitespace tokens of a text; blank text has none."""
    body = strip(col)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"(?U)\s+"))


def split_punct(col) -> tuple[Column, Column, Column]:
    """(bare, possessive, punctuation) of a stripped token."""
    s = strip(col)
    has_p = s.rlike(TRAILING_PUNCT)
    bare = F.when(has_p, F.regexp_extract(s, TRAILING_PUNCT, 1)).otherwise(s)
    punct = F.when(has_p, F.regexp_extract(s, TRAILING_PUNCT, 2)).otherwise(F.lit(""))
    has_s = bare.rlike(POSSESSIVE)
    stem = F.when(has_s, F.regexp_extract(bare, POSSESSIVE, 1)).otherwise(bare)
    suffix = F.when(has_s, F.regexp_extract(bare, POSSESSIVE, 2)).otherwise(F.lit(""))
    return stem, suffix, punct


def token_class(col) -> Column:
    """'script' for non-Latin tokens, 'symbol' for symbol-only ones, else null."""
    s = strip(col)
    return (F.when((s != "") & s.rlike(r"[^\x00-\x7f]") & ~s.rlike("[a-zA-Z]"), "script")
            .when((s != "") & s.rlike(SYMBOLS_ONLY), "symbol"))


def is_filler(col) -> Column:
    return letters(col).isin(FILLERS)


def slug(col) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_world(col) -> Column:
    """Lower-case letters and digits, single spaces, no leading article."""
    n = F.btrim(F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), "[^a-z0-9]+", " "))
    return F.regexp_replace(n, "^the ", "")


def world_or_none(col) -> Column:
    """Blank out answers that mean 'no known world'."""
    return F.when(F.lower(F.btrim(_c(col))).isin(NOT_A_WORLD), "").otherwise(_c(col))


def claims_none(col) -> Column:
    n = normalize_world(col)
    hit = n == ""
    for marker in NONE_MARKERS:
        hit = hit | n.contains(marker)
    return hit


def cue_tags(col, cues: dict[str, list[str]] = CUES) -> Column:
    """Cue kinds found in a line, in the order of ``cues``."""
    return F.array_compact(F.array(*[
        F.when(_c(col).rlike("(?i)" + "|".join(f"(?:{p})" for p in pats)), kind) for kind, pats in cues.items()]))


def is_winddown(col, patterns: list[str] = CUES["WINDDOWN"]) -> Column:
    return _c(col).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def clock(seconds) -> Column:
    """m:ss.cc"""
    s = _c(seconds)
    return F.format_string("%d:%05.2f", F.floor(s / 60), s - F.floor(s / 60) * 60)


def clock_grid(seconds) -> Column:
    """m:ss of the rounded seconds (halves to even)."""
    s = F.bround(_c(seconds)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s - F.floor(s / 60) * 60)


def speaker_display(col) -> Column:
    n = F.regexp_extract(_c(col), r"^SPEAKER_(\d+)$", 1)
    return (F.when(n != "", F.concat(F.lit("Speaker "), n.cast("int").cast("string")))
            .otherwise(F.when(F.coalesce(_c(col), F.lit("")) == "", "?").otherwise(_c(col))))


def speaker_number(col) -> Column:
    return F.regexp_extract(_c(col), r"(\d+)$", 1).try_cast("int")


def gap_id(start_seconds) -> Column:
    """'gap_' and the seconds with three decimals, rounded from the double's exact value, an exact half to the even digit.

    Spark's own formats round the shortest decimal form of a double instead: 375908.6985 is a little less than that.
    The fraction is cut in two so that both parts times 1000 are exact.
    """
    x = _c(start_seconds)
    fraction = F.abs(x) - F.floor(F.abs(x))
    high = F.floor(fraction * 2 ** 26) / F.lit(float(2 ** 26))
    whole = F.floor(high * 1000)
    rest = (high * 1000 - whole) + (fraction - high) * 1000
    up = (rest > 0.5) | ((rest == 0.5) & (whole % 2 == 1))
    thousandths = F.floor(F.abs(x)) * 1000 + whole + up.cast("int")
    return F.concat(F.lit("gap_"), F.when(x < 0, "-").otherwise(""), ((thousandths - thousandths % 1000) / 1000).cast("long").cast("string"),
                    F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))


def forms(cleaned) -> Column:
    """Each token of a cleaned spelling, and the spelling without spaces."""
    c = _c(cleaned)
    return F.array_distinct(F.concat(F.array(F.replace(c, F.lit(" "), F.lit(""))),
                                     F.filter(F.split(c, " "), lambda x: x != "")))


def heard_forms(col) -> Column:
    """Cleaned tokens of a spelling and its cleaned whole."""
    parts = F.filter(F.transform(F.split(strip(col), r"(?U)\s+"), clean), lambda x: x != "")
    return F.array_distinct(F.concat(parts, F.array(clean(col))))
