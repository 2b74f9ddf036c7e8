"""Chat formatting by schema fingerprints.

Records come as JSON objects of unlike layouts: a prompt with a completion, an instruction
with an input and an output, lists of messages under several names. A record's nested field
paths, hashed, are its fingerprint; it selects one of a table of declarative mappings, which
says where the turns are and what their roles are called. The canonical turns are then
written by a template that escapes every control string inside texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.functions.spans import scan

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``schema`` is the record's schema as a DDL string. Either ``messages`` names an array
    and ``role`` and ``text`` its elements' fields, or ``fields`` lists (role, fields whose
    non-empty texts, joined by a blank line, are that turn) in order.
    """

    name: str
    schema: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """64 bits in hex of a layout's sorted field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _messages(name: str, role: str, text: str) -> Mapping:
    return Mapping(f"{name}/{role}/{text}", f"{name} array<struct<{role}:string,{text}:string>>", (name, f"{name}[].{role}", f"{name}[].{text}"), name, role, text)


def _fields(*turns: tuple[str, tuple[str, ...]]) -> Mapping:
    names = [n for _, ns in turns for n in ns]
    return Mapping("+".join(names), ", ".join(f"{n} string" for n in names), tuple(names), fields=turns)


#: The layouts that are known; a caller may pass more.
MAPPINGS: tuple[Mapping, ...] = (
    _messages("messages", "role", "content"),
    _messages("messages", "role", "text"),
    _messages("conversation", "role", "content"),
    _messages("conversations", "from", "value"),
    _messages("turns", "speaker", "utterance"),
    _fields(("user", ("prompt",)), ("assistant", ("completion",))),
    _fields(("user", ("prompt",)), ("assistant", ("response",))),
    _fields(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _fields(("user", ("question",)), ("assistant", ("answer",))),
    _fields(("user", ("instruction",)), ("assistant", ("output",))),
    _fields(("user", ("instruction", "input")), ("assistant", ("output",))),
    _fields(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
)

# Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def record_paths(record: Column) -> Column:
    """The nested field paths of a JSON object, sorted; null where it is no JSON object.

    An array's elements count as one, ``name[]``. Values do not matter, nor do their types.
    """
    # The variant's own schema lists the fields of all nested objects in order of name, with
    # the elements of an array merged; a fold over its tokens keeps the path to each field.
    schema = F.schema_of_variant(F.try_parse_json(record))
    token = r"`(?:[^`]|``)*+`: |[^\s<>,:]+: |OBJECT<|ARRAY<|>"
    tokens = F.regexp_extract_all(schema, F.lit(token), F.lit(0))
    start, none = F.struct(F.expr("array('')").alias("stack"), F.lit("").alias("name")), F.expr("cast(array() as array<string>)")

    def step(state: Column, t: Column) -> tuple[Column, Column]:
        top = F.element_at(state["stack"], -1)
        named = F.when(top == "", F.regexp_replace(t, "`|: $", "")).otherwise(F.concat(top, F.lit("."), F.regexp_replace(t, "`|: $", "")))
        opened = F.when(state["name"] == "", top).otherwise(state["name"])
        at = lambda stack, name: F.struct(stack.alias("stack"), name.alias("name"))
        pushed = lambda path: at(F.concat(state["stack"], F.array(path)), F.lit(""))
        bracket = (t == ">") | (t == "OBJECT<") | (t == "ARRAY<")
        after = (
            F.when(t == ">", at(F.slice(state["stack"], F.lit(1), F.size(state["stack"]) - 1), F.lit("")))
            .when(t == "OBJECT<", pushed(opened))
            .when(t == "ARRAY<", pushed(F.concat(opened, F.lit("[]"))))
            .otherwise(at(state["stack"], named))
        )
        return after, F.when(bracket, none).otherwise(F.array(named))

    paths = F.array_sort(F.array_distinct(scan(tokens, start, "string", step)))
    return F.when(F.startswith(schema, F.lit("OBJECT")), paths)


def record_fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(F.array_join(record_paths(record), "\n").cast("binary"), 256), 1, 16)


def outline(record: Column) -> Column:
    """A JSON object with the same field paths, short enough to parse however long its texts are.

    Its string values are emptied, but for ones that JSON does not allow, and of equal objects
    that follow one another in an array one is left. What is no JSON stays none.
    """
    name = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    valid = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*+)*+'
    emptied = F.regexp_replace(record, rf'(?s)({name}\s*+:)|("){valid}(")|({name})', "$1$2$3$4")
    return F.regexp_replace(emptied, rf'(?s)({name}|:\s*+\{{)|(\{{(?:[^\[\]{{}}"]|{name})*+\}})(?:\s*+,\s*+\2)++', "$1$2")


# Options by which Spark's parser takes strings of any length, and stops where it cannot read.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1), "mode": "FAILFAST"}


def _turns(record: Column, m: Mapping, any_length: bool, cited: Column | None) -> Column:
    parsed = F.from_json(record, m.schema, ANY_LENGTH if any_length else None)
    meant = lambda c: c if cited is None else F.when(cited.isNull(), c).otherwise(F.get(cited, c.cast("int")))
    text = lambda c: F.coalesce(meant(c), F.lit(""))
    if m.messages:
        return F.transform(parsed[m.messages], lambda x: F.struct(text(x[m.role]).alias("role"), text(x[m.text]).alias("text")))
    turns = []
    for role, names in m.fields:
        body = F.array_join(F.filter(F.array(*[text(parsed[n]) for n in names]), lambda t: t != ""), "\n\n") if len(names) > 1 else text(parsed[names[0]])
        turns.append(F.struct(F.lit(role).alias("role"), body.alias("text")))
    # a system prompt that is empty is no turn
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


# Records above this many characters may pass a limit of Spark's JSON parsers,
# which then give null; and the column in which turns come that need no parsing.
PARSED_FOR_SURE = 16_000_000
BUILT = "built_turns"
BUILT_LAYOUT = MAPPINGS[0]


def _too_long(record: Column) -> Column:
    return F.raise_error(F.concat(F.lit("a JSON record of "), F.length(record).cast("string"), F.lit(" characters is too long for Spark's parsers")))


def canonical_turns(
    records: DataFrame,
    record_col: str = "record",
    mappings: tuple[Mapping, ...] = MAPPINGS,
    role_names: dict[str, str] = ROLE_NAMES,
    any_length: bool = False,
    cited_col: str | None = None,
) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` (role and text, in order).

    Rows with turns in a column ``built_turns``, see :func:`from_turn_rows`, take these as
    they are, without fingerprints, and count as of the layout ``messages``; they may be of
    any length. Of parsed records the names of roles in ``role_names`` (human, gpt, bot and
    model) are translated. A JSON object that is too long for Spark's parsers stops the job;
    with ``any_length`` texts are as long as a value can be, fingerprints are those of the
    records' :func:`outline`, and only an outline that is too long itself stops the job.
    Where the array ``cited_col`` is not null, a record's strings are positions (from 0) of
    the strings that are meant, so that long texts need no parsing; its paths are as ever.

    Records of a layout that no mapping knows, and texts that are no JSON objects, have
    ``layout`` and ``turns`` null; nothing is dropped. Null roles and texts are empty. Other
    columns pass through; ones of these three names are replaced. Repeated rows are read
    alike, and an empty table gives no rows.
    """
    record = F.col(record_col)
    mark = F.col("fingerprint")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        known = mark == fingerprint(m.paths)
        layout, turns = F.when(known, m.name).otherwise(layout), F.when(known, _turns(record, m, any_length, F.col(cited_col) if cited_col else None)).otherwise(turns)
    built = F.col(BUILT) if BUILT in records.columns else F.lit(None).cast(TURNS)
    long, object_like = F.length(record) > PARSED_FOR_SURE, record.rlike(r"\A\s*\{") & record.rlike(r"\}\s*\z")
    read = record_fingerprint(outline(record) if any_length else record)
    # a limit of the parsers is an error, and changes no record's way
    unread = long & object_like & read.isNull()
    if any_length:
        unread &= F.length(outline(record)) > PARSED_FOR_SURE
    else:
        # of a known layout and so long, but without any text
        empty = turns.isNull() | ~F.exists(turns, lambda t: t["text"] != "")
        turns = F.when(long & layout.isNotNull() & empty, _too_long(record).cast(TURNS)).otherwise(turns)
    read = F.when(unread, _too_long(record)).otherwise(read)
    read, layout = F.when(built.isNull(), read).otherwise(fingerprint(BUILT_LAYOUT.paths)), F.when(built.isNull(), layout).otherwise(BUILT_LAYOUT.name)
    if role_names:
        renamed = lambda role: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in role_names.items() for x in kv]), role), role)
        turns = F.transform(turns, lambda t: F.struct(renamed(t["role"]).alias("role"), t["text"].alias("text")))
    return records.withColumn("fingerprint", read).withColumn("layout", layout).withColumn("turns", F.coalesce(built, turns))


# The template. Every control string begins with < or [, and escaped texts
# hold neither, so no text can be read as one.
BEGIN, ROLE_END, TURN_END, END = "<s>", "[/ROLE]", "[/TURN]", "</s>"
ROLE_BEGIN = "[ROLE]"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_turns(turns: Column) -> Column:
    """The formatted conversation; null turns give null."""
    body = F.transform(
        turns, lambda t: F.concat(F.lit(ROLE_BEGIN), escape(t["role"]), F.lit(ROLE_END), escape(t["text"]), F.lit(TURN_END))
    )
    return F.concat(F.lit(BEGIN), F.array_join(body, ""), F.lit(END))


def parse_formatted(formatted: Column) -> Column:
    """``array<struct<role, text, start, end>>`` of a formatted conversation.

    ``start`` and ``end`` bound the turn's escaped text in the formatted one, in code points.
    """
    inner = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted) - len(BEGIN) - len(END))
    pieces = F.split(inner, r"\[/TURN\]", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    kind = "struct<role:string,text:string,start:int,end:int>"

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        role_end = F.locate(ROLE_END, piece)
        head = role_end + (len(ROLE_END) - 1)
        role = F.substring(piece, F.lit(len(ROLE_BEGIN) + 1), role_end - (len(ROLE_BEGIN) + 1))
        text = F.substring(piece, head + 1, F.length(piece))
        turn = F.struct(unescape(role).alias("role"), unescape(text).alias("text"), (at + head).alias("start"), (at + F.length(piece)).alias("end"))
        return at + F.length(piece) + len(TURN_END), F.array(turn)

    return F.when(formatted.isNotNull(), scan(pieces, F.lit(len(BEGIN)), kind, step))


def loss_spans(parsed: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """``array<struct<start, end>>`` of the formatted text that the loss covers."""
    return F.transform(F.filter(parsed, lambda t: t["role"].isin(*roles)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def format_records(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, **options) -> DataFrame:
    """``records`` with ``fingerprint, layout, turns, formatted, loss_mask``.

    ``loss_mask`` are the code-point spans of ``formatted`` that assistants wrote. Columns of
    these names are replaced; see :func:`canonical_turns` for its ``options`` and for unknown
    layouts, whose ``formatted`` and ``loss_mask`` are null.
    """
    out = canonical_turns(records, record_col, mappings, **options).withColumn("formatted", format_turns(F.col("turns")))
    return out.withColumn("loss_mask", loss_spans(parse_formatted(F.col("formatted"))))


def from_turn_rows(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cite_above: int | None = None
) -> DataFrame:
    """``conv_col, record, built_turns``: the rows of each conversation as one record with ``messages``.

    ``built_turns`` holds the same turns (role and text), which :func:`canonical_turns` takes
    without parsing ``record``. With ``cite_above``, ``cited`` follows: in a record of more
    characters of roles and texts, all strings are positions in this array, which holds the
    roles and texts; it is null for other records.

    Rows come by turn, null turns first, and rows of one turn by role and text. A null
    conversation id forms a conversation of its own. A conversation is one value, so its
    rows meet in one task; conversations are as long as people talk, and many equal ones
    are many ids. Texts may be of any length that one value can have (two gigabytes a
    conversation); an empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["role"], r["content"]))
    grouped = rows.groupBy(conv_col).agg(messages.alias("messages"))
    built = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))
    record = F.to_json(F.struct("messages"))
    if cite_above is None:
        return grouped.select(conv_col, record.alias("record"), built.alias(BUILT))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["role"]) + F.length(m["content"]))
    places = F.transform("messages", lambda m, i: F.struct((2 * i).cast("string").alias("role"), (2 * i + 1).cast("string").alias("content")))
    strings = F.flatten(F.transform("messages", lambda m: F.array(m["role"], m["content"])))
    record = F.when(chars > cite_above, F.to_json(F.struct(places.alias("messages")))).otherwise(record)
    return grouped.select(conv_col, record.alias("record"), built.alias(BUILT), F.when(chars > cite_above, strings).alias("cited"))
