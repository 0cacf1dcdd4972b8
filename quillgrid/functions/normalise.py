"""Column functions that turn messy values into clean ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import let, trim_ws
from quillgrid.functions.text import is_missing

# Tag, pattern, parse format of each accepted date form.
DATE_FORMS = (
    ("MM/DD/YYYY", r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    ("Month D YYYY", r"^[A-Za-z]{3,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    ("DD-Mon-YYYY", r"^\d{2}-[A-Za-z]{3}-\d{4}$", "dd-MMM-yyyy"),
    ("YYYY/MM/DD", r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    ("Mon YYYY", r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
)
AMBIGUOUS_DATE = r"^\d{1,2}-\d{4}$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CURRENCY_SYMBOLS = "$€£"


def number(value: Column, symbols: str = CURRENCY_SYMBOLS) -> Column:
    """Number without currency symbols and thousands commas; NULL if the value is not numeric."""
    bare = F.translate(trim_ws(value), symbols + ",", "")
    return let(bare, lambda b: F.when(b.rlike(PLAIN_NUMBER), b.try_cast("double")))


def number_form(value: Column) -> Column:
    """Shape of a number text, such as ``$XX,XXX`` or ``text ('plenty')``."""
    return let(
        trim_ws(value),
        lambda v: F.when(is_missing(v), F.lit(None).cast("string"))
        .when(number(v).isNotNull(), F.regexp_replace(v, r"\d", "X"))
        .otherwise(F.concat(F.lit("text ('"), v, F.lit("')"))),
    )


def date_form(value: Column) -> Column:
    """Tag of the date form, or NULL. The form decides the parser, never trial and error."""
    def tag(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern, _ in reversed(DATE_FORMS):
            out = F.when(v.rlike(pattern), name).otherwise(out)
        return out

    return let(F.replace(trim_ws(value), F.lit(","), F.lit("")), tag)


def date(value: Column) -> Column:
    """ISO date of any accepted form; month-year means the first of the month."""
    def parse(v: Column) -> Column:
        parsed = F.lit(None).cast("date")
        for name, pattern, form in reversed(DATE_FORMS):
            made = F.try_to_timestamp(v, F.lit(form)).cast("date")
            if name == "Month D YYYY":
                short = F.try_to_timestamp(v, F.lit("MMM d yyyy")).cast("date")
                made = F.coalesce(made, short)
            parsed = F.when(v.rlike(pattern), made).otherwise(parsed)
        return parsed

    return let(F.replace(trim_ws(value), F.lit(","), F.lit("")), parse)


def date_issue(value: Column) -> Column:
    """Why a present date text has no ISO date."""
    v = trim_ws(value)
    quoted = F.concat(F.lit("date '"), v, F.lit("'"))
    return F.when(is_missing(v) | date(v).isNotNull(), F.lit(None).cast("string")).when(
        v.rlike(AMBIGUOUS_DATE), F.concat(quoted, F.lit(" ambiguous"))
    ).otherwise(F.concat(quoted, F.lit(" not recognised")))


def number_issue(name: str, value: Column, absent_as_missing: bool = True) -> Column:
    """Why a present number text has no numeric value, or that it is missing."""
    v = trim_ws(value)
    text = (
        F.when(v == "", F.lit(f"missing {name}"))
        .when(is_missing(v), F.concat(F.lit(f"{name} '"), v, F.lit("'")))
        .when(number(v).isNull(), F.concat(F.lit(f"{name} '"), v, F.lit("' not numeric")))
    )
    return text if absent_as_missing else F.when(v != "", text)


def email_issue(value: Column) -> Column:
    v = trim_ws(value)
    return F.when(v == "", F.lit("missing email")).when(
        F.contains(v, F.lit("@")) & ~v.rlike(r"@[^@]+\.[A-Za-z]{2,}$"), F.lit("incomplete email domain")
    )


def missing_issue(name: str, value: Column) -> Column:
    return F.when(is_missing(trim_ws(value)), F.lit(f"missing {name}"))


def present(value: Column) -> Column:
    """Trimmed text, NULL for missing tokens."""
    return let(trim_ws(value), lambda v: F.when(~is_missing(v), v))


def camel_name(name: str) -> str:
    """camelCase of a column name, for schemas known on the driver."""
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in name).split() if w]
    words = [w.lower() if w.upper() == w else w for w in words]
    return "".join(w[:1].lower() + w[1:] if i == 0 else w[:1].upper() + w[1:] for i, w in enumerate(words))


def camel_case(value: Column) -> Column:
    """camelCase of a text value."""
    words = F.filter(F.split(value, "[^A-Za-z0-9]+", -1), lambda w: w != "")

    def cased(w: Column, i: Column) -> Column:
        base = F.when(F.upper(w) == w, F.lower(w)).otherwise(w)
        head = F.left(base, F.lit(1))
        return F.concat(F.when(i == 0, F.lower(head)).otherwise(F.upper(head)), F.substring(base, F.lit(2), F.length(base)))

    return F.array_join(F.transform(words, cased), "")


def alias(value: Column, names: Mapping[str, str]) -> Column:
    """Canonical name of a value; values without an alias stay as they are."""
    if not names:
        return value
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)
