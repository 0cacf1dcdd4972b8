"""Column functions over raw text: types, tokens, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import jsontext
from quillgrid.functions.core import head_lines, let, occurrences, trim_ws


def csv_field_count(line: Column) -> Column:
    """Number of comma fields in one line; NULL for a blank line or a misplaced quote."""
    def count(text: Column) -> Column:
        return occurrences(text, ",") + 1

    def quoted(text: Column) -> Column:
        # Possessive quantifiers keep the matcher iterative on long fields.
        bare = F.regexp_replace(text, r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)', "$1")
        return let(bare, lambda b: F.when(~F.contains(b, F.lit('"')), count(b)))

    def of(text: Column) -> Column:
        return (
            F.when(text == "", F.lit(None).cast("int"))
            .when(~F.contains(text, F.lit('"')), count(text))
            .otherwise(quoted(text))
        )

    return let(F.regexp_replace(line, r"\r$", ""), of)


def csv_like(lines: Column) -> Column:
    """Two lines with about the same number of comma fields, or a header with tabs."""
    def judge(s: Column) -> Column:
        first, second = s["first"], s["second"]
        by_comma = F.coalesce((second >= first - 1) & (second <= first + 1), F.lit(False))
        return F.when(first >= 2, by_comma).otherwise(F.contains(s["header"], F.lit("\t")))

    header, following = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    counts = F.struct(
        header.alias("header"),
        csv_field_count(header).alias("first"),
        csv_field_count(following).alias("second"),
    )
    return F.when(F.size(lines) >= 2, let(counts, judge)).otherwise(False)


#: White space before a line's first character.
_INDENT = "[" + K.WHITE_SPACE.replace("\n", "") + "]*+"


def _matching(text: Column, pattern: str) -> Column:
    """How many lines, without white space around them, match a pattern that starts with ``^``; one pass over the text."""
    within = pattern.removeprefix("^").replace(r"\s", r"[^\S\n]")
    return F.regexp_count(text, F.lit(f"(?dm)^{_INDENT}(?:{within})"))


def doc_type(text: Column, window: tuple[int, int] | None = None) -> Column:
    """Document type; the first rule that holds decides.

    The rules on lines count all lines. A ``window`` makes them count the first lines alone: so many for logs and headings, so many for
    key-value lines (``constants.TYPE_WINDOW`` is the pair that others use).
    """
    def by_lines(t: Column) -> Column:
        def judge(s: Column) -> Column:
            lines = lambda x: occurrences(x, "\n") + 1
            return (
                F.when(_matching(s["top"], K.LOG_LINE) > F.floor(lines(s["top"]) / 2), K.LOG)
                .when(_matching(s["top"], K.MARKDOWN_HEADING) >= 2, K.MARKDOWN)
                .when(_matching(s["head"], K.KEY_VALUE_LINE) > F.floor(lines(s["head"]) / 3), K.KEY_VALUE)
                .otherwise(K.UNKNOWN)
            )

        top, head = (t, t) if window is None else (F.substring_index(t, "\n", window[0]), F.substring_index(t, "\n", window[1]))
        is_csv = F.contains(t, F.lit("\n")) & let(head_lines(t, 2), csv_like)
        return F.when(is_csv, K.CSV).otherwise(let(F.struct(top.alias("top"), head.alias("head")), judge))

    def by_text(t: Column) -> Column:
        opening = F.left(t, F.lit(1))
        is_json = opening.isin("{", "[") & jsontext.is_valid(t, trimmed=True)
        is_xml = t.startswith("<?xml") | ((opening == "<") & t.rlike(K.XML_TAG))
        return (
            F.when(t == "", K.UNKNOWN)
            .when(is_json, K.JSON)
            .when(is_xml, K.XML)
            .otherwise(by_lines(t))
        )

    return let(trim_ws(text), by_text)


def is_missing(value: Column) -> Column:
    """Tokens that stand for a missing value."""
    return F.lower(value).isin(*K.MISSING_TOKENS)


def classify_value(value: Column) -> Column:
    """Semantic type of one text value."""
    def bare_number(v: Column) -> Column:
        return F.replace(F.regexp_replace(v, r"^\$?€?", ""), F.lit(","), F.lit(""))

    return (
        F.when(value.rlike(K.EMAIL), "email")
        .when(value.rlike(K.URL), "url")
        .when(value.rlike(K.DATE), "date")
        .when(F.lower(value).isin("true", "false"), "boolean")
        .when(bare_number(value).rlike(K.NUMBER), "number")
        .otherwise("string")
    )


def collapse_types(types: Column) -> Column:
    """One type stays, none is null, several are mixed."""
    return let(
        types,
        lambda t: F.when(F.size(t) == 0, "null").when(F.size(t) == 1, F.get(t, F.lit(0))).otherwise("mixed"),
    )


def currency_cells(text: Column) -> Column:
    """Comma cells holding only a currency amount."""
    cells = F.split(text, "[,\n]", -1)
    return F.size(F.filter(cells, lambda c: trim_ws(c).rlike(K.CURRENCY_CELL)))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN), F.lit(0))


def split_sentences(text: Column) -> Column:
    """Cut after ``. ! ?`` or a line end where a blank follows; pieces are trimmed."""
    return F.transform(F.split(text, r"(?<=[.!?\n])(?= )", -1), trim_ws)


def chunk_pieces(text: Column, size: int = K.CHUNK_BYTES) -> Column:
    """Units the packer may not cut: ``struct(text, sep, force)``.

    A paragraph that fits is one unit. A longer one gives its sentences, the first of which
    always starts a new chunk.
    """
    def piece(body: Column, sep: str, force: Column) -> Column:
        return F.struct(body.alias("text"), F.lit(sep).alias("sep"), force.alias("force"))

    def of_paragraph(p: Column) -> Column:
        return F.when(
            F.octet_length(p) <= size, F.array(piece(p, "\n\n", F.lit(False)))
        ).otherwise(
            F.transform(split_sentences(p), lambda s, i: piece(s, " ", i == 0))
        )

    def of_text(t: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(t, "\n\n", -1), trim_ws), lambda p: p != "")
        return F.when(
            F.octet_length(t) <= size, F.array(piece(t, "\n\n", F.lit(False)))
        ).otherwise(F.flatten(F.transform(paragraphs, of_paragraph)))

    return let(trim_ws(text), of_text)


def pack_pieces(pieces: Column, size: int = K.CHUNK_BYTES) -> Column:
    """Greedy packing of pieces into chunks of about ``size`` bytes."""
    state = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"),
    )

    def closed(opened: Column) -> Column:
        # Pieces are trimmed, so a chunk has white space at its ends only after an empty piece, whose separator is a blank.
        return F.when(opened.endswith(" "), trim_ws(opened)).otherwise(opened)

    def step(acc: Column, p: Column) -> Column:
        opened = acc["open"]
        room = F.octet_length(opened) + F.octet_length(p["text"]) + F.octet_length(p["sep"])
        return (
            F.when(opened == "", F.struct(acc["done"].alias("done"), p["text"].alias("open")))
            .when(
                p["force"] | (room > size),
                F.struct(
                    F.array_append(acc["done"], closed(opened)).alias("done"),
                    p["text"].alias("open"),
                ),
            )
            .otherwise(
                F.struct(
                    acc["done"].alias("done"),
                    F.concat(opened, p["sep"], p["text"]).alias("open"),
                )
            )
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(
            F.array_append(acc["done"], closed(acc["open"]))
        )

    return F.aggregate(pieces, state, step, finish)


def chunk_text(text: Column, size: int = K.CHUNK_BYTES) -> Column:
    return pack_pieces(chunk_pieces(text, size), size)


def significant_tokens(text: Column) -> Column:
    """Distinct words that carry data: numbers, amounts, addresses with ``@``."""
    words = F.transform(
        F.split(text, r"\p{IsWhite_Space}+", -1), lambda w: F.btrim(w, F.lit(K.WORD_PUNCTUATION))
    )
    return F.array_distinct(
        F.filter(
            words,
            lambda w: (F.octet_length(w) >= 2)
            & (
                ((F.octet_length(w) >= 3) & w.rlike(r"^[0-9$]"))
                | F.contains(w, F.lit("@"))
            ),
        )
    )


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")
