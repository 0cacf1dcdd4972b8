"""Delimited text held in a column: records, fields, separators, repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import let, occurrences, trim_ws
from quillgrid.functions.text import csv_field_count

# Stand-ins for separators and line ends inside quoted fields while a text is being split.
_PROTECTED = ",\t\n\r"
_STAND_INS = "\x01\x02\x03\x04"


def separator(text: Column) -> Column:
    """Comma, or tab where the header has no two comma fields but has a tab."""
    header = F.get(F.split(trim_ws(text), "\n", 2), F.lit(0))
    return let(
        header,
        lambda h: F.when(
            (F.coalesce(csv_field_count(h), F.lit(0)) < 2) & F.contains(h, F.lit("\t")), "\t"
        ).otherwise(","),
    )


def _unquoted(text: Column, sep: str) -> Column:
    """The text with quoted fields opened and their separators replaced by stand-ins."""
    end = rf"(?={sep}|\r?\n|\z)"
    quoted = rf'[ \t]*+"(?:[^"]++|""|"(?!{sep}|\r?\n|\z))*+(?:"{end}|\z)'
    field = rf"(?:{quoted}|[^{sep}\n]*+)(?:{sep}|\n|\z)"
    opened = rf'^[ \t]*+"((?:[^"]++|""|"(?!{sep}|\r?\n|\z))*+)"?({sep}|\r?\n|\z)?$'

    def plain(token: Column) -> Column:
        body = F.replace(F.regexp_extract(token, rf"(?s){opened}", 1), F.lit('""'), F.lit('"'))
        tail = F.regexp_extract(token, rf"(?s){opened}", 2)
        return F.when(
            F.ltrim(token).startswith('"'), F.concat(F.translate(body, _PROTECTED, _STAND_INS), tail)
        ).otherwise(token)

    # A misplaced match at the very end of the text is empty and adds nothing to the join.
    tokens = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(field), F.lit(0))
    return F.array_join(F.transform(tokens, plain), "")


def repair_amounts(line: Column) -> Column:
    """Join thousands groups of currency amounts that were not quoted: ``$85,000`` -> ``$85000``."""
    # A further group follows where the last one ended.
    return F.regexp_replace(line, r"(\G(?!^)|[$€£]\d++),(\d{3})(?!\d)", "$1$2")


def records(text: Column, repair: bool = True) -> Column:
    """``array<array<string>>``: header first, blank lines dropped, fields trimmed.

    With ``repair``, a line with more fields than the header has its unquoted amounts joined first.
    """
    def split_lines(plain: Column, sep: str) -> Column:
        lines = F.filter(F.split(plain, r"\r?\n", -1), lambda l: l != "")

        def fields(line: Column) -> Column:
            return F.transform(
                F.split(line, sep, -1),
                lambda f: trim_ws(F.translate(f, _STAND_INS, _PROTECTED)),
            )

        def mend(all_lines: Column) -> Column:
            width = occurrences(F.get(all_lines, F.lit(0)), sep)
            return let(
                width,
                lambda w: F.transform(
                    all_lines,
                    lambda l: F.when(occurrences(l, sep) > w, repair_amounts(l)).otherwise(l),
                ),
            )

        return F.transform(let(lines, mend) if repair and sep == "," else lines, fields)

    def with_sep(sep: str) -> Column:
        plain = F.when(F.contains(text, F.lit('"')), _unquoted(text, sep)).otherwise(text)
        return let(plain, lambda p: split_lines(p, sep))

    return F.when(separator(text) == "\t", with_sep("\t")).otherwise(with_sep(","))
