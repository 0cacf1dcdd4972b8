"""Chat formatting with built-in expressions alone: schema fingerprints choose mappings, a reversible template marks the turns.

A record is JSON in any of several layouts. Its schema, nested field names with array and object marks and no scalar types, is hashed to a
fingerprint, and the fingerprint selects a declarative mapping: where the turns lie, or which fields are turns of which role.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.core import let

TURNS = "array<struct<role:string,text:string>>"
END_MARK = "</turn>\n"
#: Records of more bytes do not become a VARIANT whole: it takes strings of 20,000,000 characters and values of 128 MiB at most.
LONG_BYTES = 20_000_000
#: A shape of more bytes that gives no variant is an error, not invalid JSON.
SHAPE_BYTES = 20_000_000


@dataclass(frozen=True)
class Layout:
    """A mapping: ``schema`` is the record's shape in the notation of ``schema_of_variant`` with every scalar written ``V``.

    Either ``turns`` names an array with ``role`` and ``text`` fields, or ``fields`` gives (field, role) pairs in turn order. Fields that
    share a role and follow each other join to one turn, parted by an empty line; empty ones are left out, but for the last.
    """

    name: str
    schema: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()


def _object(**members: str) -> str:
    return "OBJECT<" + ", ".join(f"{k}: {v}" for k, v in sorted(members.items())) + ">"


def _of_turns(name: str, field: str, role: str, text: str, **more: str) -> Layout:
    return Layout(name, _object(**{field: f"ARRAY<{_object(**{role: 'V', text: 'V'})}>"}, **more), field, role, text)


def _of_fields(name: str, *fields: tuple[str, str]) -> Layout:
    return Layout(name, _object(**{f: "V" for f, _ in fields}), fields=fields)


LAYOUTS = (
    _of_turns("messages", "messages", "role", "content"),
    _of_turns("messages_id", "messages", "role", "content", id="V"),
    _of_turns("messages_text", "messages", "role", "text"),
    _of_turns("conversations", "conversations", "from", "value"),
    _of_turns("conversations_id", "conversations", "from", "value", id="V"),
    _of_turns("dialog", "dialog", "speaker", "utterance"),
    _of_fields("instruction", ("instruction", "user"), ("output", "assistant")),
    _of_fields("instruction_input", ("instruction", "user"), ("input", "user"), ("output", "assistant")),
    _of_fields("system_instruction_input", ("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
    _of_fields("prompt_completion", ("prompt", "user"), ("completion", "assistant")),
    _of_fields("prompt_response", ("prompt", "user"), ("response", "assistant")),
    _of_fields("system_prompt_response", ("system", "system"), ("prompt", "user"), ("response", "assistant")),
    _of_fields("question_answer", ("question", "user"), ("answer", "assistant")),
    _of_fields("question_context_answer", ("context", "user"), ("question", "user"), ("answer", "assistant")),
)

#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_shape(record: Column) -> Column:
    """Nested field paths of a parsed record (variant): its schema with every scalar type written ``V``."""
    scalar = r"(?<=[<:] ?)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|VARIANT|DECIMAL\(\d+,\s?\d+\))(?=[>,]|$)"
    return F.regexp_replace(F.schema_of_variant(record), scalar, "V")


def fingerprint(shape: Column) -> Column:
    """64-bit hash of a shape."""
    return F.xxhash64(shape)


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def map_turns(record: Column, layout: Layout) -> Column:
    """The canonical turns of a record in this layout."""
    if layout.turns:
        items = F.try_variant_get(record, f"$.{layout.turns}", "array<variant>")
        return F.transform(items, lambda x: _turn(canonical_role(_text(x, layout.role)), _text(x, layout.text)))
    return _turns_of_fields(lambda field: _text(record, field), layout)


def _turns_of_fields(text: Callable[[str], Column], layout: Layout) -> Column:
    turns, last = [], layout.fields[-1][0]
    groups: list[tuple[str, list[str]]] = []
    for field, role in layout.fields:
        if groups and groups[-1][0] == role:
            groups[-1][1].append(field)
        else:
            groups.append((role, [field]))
    for role, fields in groups:
        parts = F.filter(F.array(*[text(f) for f in fields]), lambda p: p != "")
        turn = _turn(F.lit(role), F.array_join(parts, "\n\n"))
        turns.append(turn if last in fields or role == "user" else F.when(F.size(parts) > 0, turn))
    return F.array_compact(F.array(*turns))


def without_texts(record: Column) -> Column:
    """A JSON text with its string values emptied: the same shape in few bytes. Names are kept, but for escapes that no layout has."""
    plain = F.regexp_replace(record, r'\\["\\/bfnrt]', "?")
    return F.regexp_replace(plain, r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')


def parse_record(record: Column) -> Column:
    """The record as a variant, of a long one the shape alone. Null if it is no JSON; an error if even the shape is too large to tell."""
    shape = without_texts(record)
    too_large = F.raise_error(F.lit("chat record too large: its JSON without texts does not fit a VARIANT")).cast("variant")
    of_long = let(shape, lambda s: F.coalesce(F.try_parse_json(s), F.when(F.octet_length(s) > SHAPE_BYTES, too_large)))
    return F.when(F.octet_length(record) > LONG_BYTES, of_long).otherwise(F.try_parse_json(record))


def map_long_turns(text: Column, layout: Layout) -> Column:
    """``map_turns`` from the JSON text of a long record, read by a fixed schema."""
    names = dict.fromkeys([f for f, _ in layout.fields])
    fields = f"`{layout.turns}` array<struct<`{layout.role}`:string,`{layout.text}`:string>>" if layout.turns else ", ".join(f"`{n}` string" for n in names)
    options = {"maxStringLen": str(2 ** 31 - 1), "columnNameOfCorruptRecord": "_corrupt"}

    def turns(r: Column) -> Column:
        if layout.turns:
            found = F.transform(r[layout.turns], lambda x: _turn(
                canonical_role(F.coalesce(x[layout.role], F.lit(""))), F.coalesce(x[layout.text], F.lit(""))))
        else:
            found = _turns_of_fields(lambda field: F.coalesce(r[field], F.lit("")), layout)
        return F.when(r["_corrupt"].isNull(), found)

    return let(F.from_json(text, f"{fields}, _corrupt string", options), turns)


def canonical_role(role: Column) -> Column:
    """Known other names become the canonical ones; any other role stays as it is."""
    mapped = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapped, role), role)


def with_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """All columns with ``layout`` (null if none fits), ``schema_id`` (the fingerprint) and ``turns``; these names are replaced.

    ``record`` is a column of JSON texts. Null or invalid JSON, and layouts nobody registered, give null turns; null fields count as empty.
    Records of more than ``LONG_BYTES`` are told by their shape and read by the layout's schema, so any length of text is kept.
    """
    known = [c for c in df.columns if c not in ("layout", "schema_id", "turns", "_record", "_json")]
    parsed = df.select(*[F.col(f"`{c}`") for c in known], F.col(record).alias("_json"), parse_record(F.col(record)).alias("_record"))
    tagged = parsed.withColumn("schema_id", fingerprint(schema_shape(F.col("_record"))))
    name = turns = None
    for layout in layouts:
        # The layout's own shape is hashed by the same expression; the optimizer folds it to a number.
        fits = F.col("schema_id") == fingerprint(F.lit(layout.schema))
        name = F.when(fits, F.lit(layout.name)) if name is None else name.when(fits, F.lit(layout.name))
        whole = F.octet_length("_json") > LONG_BYTES
        value = F.when(whole, map_long_turns(F.col("_json"), layout).cast(TURNS)).otherwise(map_turns(F.col("_record"), layout).cast(TURNS))
        turns = F.when(fits, value) if turns is None else turns.when(fits, value)
    return tagged.select(*[F.col(f"`{c}`") for c in known], name.alias("layout"), "schema_id", turns.alias("turns"))


def escape(text: Column) -> Column:
    r"""``\`` as ``\\``, ``<`` as ``\l``, ``#`` as ``\h``: no mark of the template can then occur in a text."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def escape_role(role: Column) -> Column:
    r"""As ``escape``, and ``:`` as ``\c``, for a colon ends the role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    r"""The text before ``escape`` or ``escape_role``. Parting at ``\\`` from the left never splits another escape."""
    def plain(part: Column) -> Column:
        for code, char in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def render(turns: Column) -> Column:
    r"""``struct<formatted, loss>``: each turn is ``### role: text</turn>`` and a line end; ``loss`` has begin and end, in code points, of
    every assistant text within ``formatted``."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"),
        (F.coalesce(t["role"], F.lit("")) == "assistant").alias("own")))

    def marks(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,stop:long>>").alias("spans"))
        lengths = F.transform(parts, lambda p: F.struct(F.length(p["head"]).cast("long").alias("h"), F.length(p["body"]).cast("long").alias("b"), p["own"].alias("own")))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["h"]
            span = F.struct(begin.alias("begin"), (begin + p["b"]).alias("stop"))
            return F.struct((begin + p["b"] + len(END_MARK)).alias("at"),
                            F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(lengths, start, step)["spans"]

    return let(pieces, lambda parts: F.struct(
        F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END_MARK))), "").alias("formatted"),
        marks(parts).alias("loss")))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered text. Marks are never part of a text, so splitting finds them all."""
    parts = F.split(formatted, END_MARK, -1)
    turns = F.filter(parts, lambda p: p != "")

    def turn(p: Column) -> Column:
        colon = F.instr(p, ": ")
        return _turn(unescape(F.substring(p, 5, colon - 5)), unescape(F.substring(p, colon + 2, F.length(p))))

    return F.transform(turns, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["begin"] + 1).cast("int"), (s["stop"] - s["begin"]).cast("int")))), "")


def format_chat(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``with_turns`` and ``formatted``, ``loss``; null where there are no turns. Clashing names are replaced."""
    found = with_turns(df.drop("formatted", "loss"), record, layouts)
    done = found.withColumn("_r", render(F.col("turns")))
    return done.withColumn("formatted", F.col("_r")["formatted"]).withColumn("loss", F.col("_r")["loss"]).drop("_r")


def as_records(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as one JSON record each conversation (``conv_id, record``), turns in order.

    A conversation is one record, so its own turns meet in one task, as its text must. Ties of a turn number are taken by role and text;
    null roles and texts count as empty, rows with a null id form one conversation.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(ordered.alias("messages"))).alias("record"))
