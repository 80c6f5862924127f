"""Chat formatting: schema fingerprints select declarative mappings to canonical turns."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.words import let

#: Control strings that must not stand unescaped in a text.
CONTROL = r"(?:/?s>|/?INST\]|<SYS>>|</SYS>>|\|[A-Za-z_]+\|>)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"
TURNS = "array<struct<role:string,text:string>>"
#: A JSON string; possessive, so that Java reads one of any length in a loop.
STRING = r'"(?s:[^"\\]++|\\.)*+(?:"|\z)'
#: Bytes of JSON that are parsed as they stand. A variant takes up to 13 bytes for 4 (``1e9,``), so it stays
#: below the 128 MiB from which on ``try_parse_json`` gives null.
WHOLE = 16 << 20
#: Jackson reads strings of up to 20 million characters only, unless told otherwise.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns: either a list of messages or single fields in order."""

    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    rename: bool = False
    fields: tuple[tuple[str, str], ...] = ()


def message_list(at: str, role: str, text: str, rename: bool = False) -> Layout:
    """A layout with a list ``at`` of objects with a role and a text; ``rename`` maps roles by ``ROLES``."""
    return Layout((at, f"{at}[].{role}", f"{at}[].{text}"), messages=(at, role, text), rename=rename)


def single_fields(*fields: tuple[str, str]) -> Layout:
    """A layout with one field per turn, given as (field, role) in the order of the turns."""
    return Layout(tuple(f for f, _ in fields), fields=fields)


#: Layouts known out of the box; each is found by the hash of its field paths.
LAYOUTS: Mapping[str, Layout] = {
    "messages": message_list("messages", "role", "content"),
    "messages_text": message_list("messages", "role", "text"),
    "conversations": message_list("conversations", "from", "value", rename=True),
    "prompt_response": single_fields(("prompt", "user"), ("response", "assistant")),
    "prompt_completion": single_fields(("prompt", "user"), ("completion", "assistant")),
    "system_prompt_response": single_fields(("system", "system"), ("prompt", "user"), ("response", "assistant")),
    "instruction_output": single_fields(("instruction", "user"), ("output", "assistant")),
    "instruction_input_output": single_fields(("instruction", "user"), ("input", "user"), ("output", "assistant")),
    "question_answer": single_fields(("question", "user"), ("answer", "assistant")),
}
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def outline(record: Column) -> Column:
    """A JSON record of the same field paths: string values empty, one of each run of equal flat objects."""
    marked = F.regexp_replace(record, rf"({STRING}\s*+:)|{STRING}", "$1\u0001")
    emptied = F.replace(F.replace(marked, F.lit(":\u0001"), F.lit(":")), F.lit("\u0001"), F.lit('""'))
    return F.regexp_replace(emptied, rf'(\{{(?:[^{{}}\[\]"]++|{STRING})*+\}})(?:\s*+,\s*+\1)++|({STRING})', "$1$2")


def field_paths(record: Column, whole: int = WHOLE) -> Column:
    """Sorted nested field paths of a JSON record (a string), lists marked ``[]``, types left out.

    ``schema_of_variant`` gives the merged shape of a record, lists included; what stands between
    its brackets is walked once, with the open path as state. A record of more than ``whole`` bytes
    is parsed by its outline, so texts of any length and any number of messages have their paths;
    where even the outline is too large for a variant, the query fails instead of giving null.
    """
    parsed = let(outline(record), lambda r: F.when(F.octet_length(r) <= whole, F.try_parse_json(r)).otherwise(F.parse_json(r)))
    shape = F.schema_of_variant(F.when(F.octet_length(record) <= whole, F.try_parse_json(record)).otherwise(parsed))
    tokens = F.regexp_extract_all(shape, F.lit(r"(OBJECT<|ARRAY<|>|`[^`]*`(?=:)|[^\s<>,:`]+(?=:))"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        top = F.coalesce(F.get(s["open"], F.size(s["open"]) - 1), F.lit(""))
        here = F.when(s["name"] == "", top).otherwise(s["name"])
        field = F.concat(F.when(top == "", "").otherwise(F.concat(top, F.lit("."))), F.regexp_replace(t, "`", ""))
        return (F.when(t == "OBJECT<", F.struct(F.concat(s["open"], F.array(here)).alias("open"), F.lit("").alias("name"), s["paths"].alias("paths")))
                .when(t == "ARRAY<", F.struct(F.concat(s["open"], F.array(F.concat(here, F.lit("[]")))).alias("open"), F.lit("").alias("name"), s["paths"].alias("paths")))
                .when(t == ">", F.struct(F.slice(s["open"], 1, F.size(s["open"]) - 1).alias("open"), F.lit("").alias("name"), s["paths"].alias("paths")))
                .otherwise(F.struct(s["open"].alias("open"), field.alias("name"), F.concat(s["paths"], F.array(field)).alias("paths"))))

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"])))


def fingerprint(paths: Column) -> Column:
    """Hash of sorted field paths."""
    return F.xxhash64(F.concat_ws("\n", paths))


def _turn(role: str, text: str, spelled: Column | None):
    def made(x: Column) -> Column:
        named = x[role] if spelled is None else F.coalesce(F.element_at(spelled, x[role]), x[role])
        return F.struct(F.coalesce(named, F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    return made


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (null: none known) and ``turns``, an array of (role, text).

    The fingerprint of each record's field paths picks the mapping. Single fields that are null
    or absent in the layout give no turn; a null text of a listed message is empty, a null role is
    the empty string. Records of no known layout, broken JSON and null keep null turns, so that they can be
    counted and sent elsewhere; none is dropped. A record and its turns are one value each, below the
    2 GiB of a Spark value.
    """
    record = F.col(record_col)
    marked = records.withColumn("_f", fingerprint(field_paths(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    spelled = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    for name, m in layouts.items():
        hit = F.col("_f") == fingerprint(F.array(*map(F.lit, sorted(m.paths))))
        if m.messages:
            at, role, text = m.messages
            parsed = F.from_json(record, f"`{at}` array<struct<`{role}`:string,`{text}`:string>>", ANY_LENGTH)[at]
            made = F.transform(parsed, _turn(role, text, spelled if m.rename else None))
        else:
            parsed = F.from_json(record, ", ".join(f"`{f}` string" for f, _ in m.fields), ANY_LENGTH)
            made = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), parsed[f].alias("text")) for f, r in m.fields]),
                            lambda x: x["text"].isNotNull())
        layout, turns = F.when(hit, name).otherwise(layout), F.when(hit, made.cast(TURNS)).otherwise(turns)
    return marked.withColumn("layout", layout).withColumn("turns", turns).drop("_f")


def escape(text: Column) -> Column:
    """A backslash goes behind the first sign of each control string; earlier backslashes there stay."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # between doubled backslashes, each left alone stands before an n
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column) -> Column:
    """Struct of the formatted text and the loss spans (start, length in code points)."""
    heads = F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")))
    bodies = F.transform(turns, lambda t: escape(t["text"]))
    parts = F.zip_with(heads, bodies, lambda h, b: F.struct(h.alias("h"), b.alias("b")))
    sized = F.zip_with(turns, parts, lambda t, p: F.struct((t["role"] == "assistant").alias("loss"), p["h"].alias("h"), p["b"].alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    tail = CLOSE + "\n"

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["h"])
        span = F.struct(begin.alias("start"), F.length(p["b"]).alias("length"))
        return F.struct((begin + F.length(p["b"]) + len(tail)).alias("at"),
                        F.when(p["loss"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return let(sized, lambda x: F.struct(
        F.array_join(F.transform(x, lambda p: F.concat(p["h"], p["b"], F.lit(tail))), "").alias("formatted"),
        F.aggregate(x, start, step, lambda s: s["spans"]).alias("loss_spans")))


def format_chats(records: DataFrame, record_col: str = "record", layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """``records`` with layout, turns, ``formatted`` and ``loss_spans`` (assistant texts only)."""
    canonical = canonical_turns(records, record_col, layouts)
    return canonical.withColumn("_r", render(F.col("turns"))).select(
        *canonical.columns, F.col("_r.formatted").alias("formatted"), F.col("_r.loss_spans").alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: the inverse of ``render``."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: let(F.locate("\n", p), lambda k: F.struct(
        _role_in(F.substring(p, F.lit(1), k - 1)).alias("role"),
        unescape(F.substring(p, k + 1, F.length(p) - k - len(CLOSE) - 1)).alias("text"))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def rows_to_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """One JSON record per conversation from one row per turn: the message-list layout.

    Turns are ordered by turn, then role and text; repeated rows stay. The result of a
    conversation is one value, so its turns meet in one row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("_m"))
    listed = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(listed.alias("messages"))).alias("record"))
