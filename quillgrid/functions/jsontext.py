"""Column functions over JSON text and VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import let, running_sums, trim_ws

OBJECT = "map<string,variant>"
ARRAY = "array<variant>"


#: Written behind a text to see where the parser stopped. Letters alone, so a text that holds neither it nor ``\\u`` cannot give it.
_END = "quillgridEnd"


def strict(text: Column, trimmed: bool = False) -> Column:
    """The parsed value, or NULL if the text is not exactly one JSON value.

    The parser ignores what follows the first value, so the text is parsed as the first of two elements, whose second is a mark. Only a text
    that could write the mark itself has to parse twice: inside brackets as the only element and inside braces as the only member.
    ``trimmed`` says that the text has no white space around it and is a bound value.
    """
    def marked(t: Column) -> Column:
        pair = F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{_END}"]')))
        return let(
            pair,
            lambda p: F.when(
                F.try_variant_get(p, "$[1]", "string") == _END, F.try_variant_get(p, "$[0]", "variant")
            ),
        )

    def twice(t: Column) -> Column:
        element = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        member = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        both = F.struct(
            F.try_variant_get(element, "$", ARRAY).alias("items"), member.isNotNull().alias("alone")
        )
        return let(
            both, lambda s: F.when((F.size(s["items"]) == 1) & s["alone"], F.get(s["items"], F.lit(0)))
        )

    def parse(t: Column) -> Column:
        # A failed parse costs more than a good one, so a text that cannot be a value by its first and last character is not parsed.
        within = lambda first, last: t.startswith(first) & t.endswith(last)
        closed = within("{", "}") | within("[", "]") | within('"', '"') | t.rlike("^(?:true|false|null|-?[0-9][-+.0-9eE]*+)$")
        risky = F.contains(t, F.lit(_END)) | F.contains(t, F.lit("\\u"))
        return F.when(closed, F.when(risky, twice(t)).otherwise(marked(t)))

    return parse(text) if trimmed else let(trim_ws(text), parse)


def is_valid(text: Column, trimmed: bool = False) -> Column:
    """Strict validity of the whole text."""
    return strict(text, trimmed).isNotNull()


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT)


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", ARRAY)


def is_object(value: Column) -> Column:
    """Whether a value is an object, without taking its members out."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def kind(value: Column) -> Column:
    """object, array, string, boolean, null or number."""
    def name(schema: Column) -> Column:
        return (
            F.when(schema.startswith("OBJECT"), "object")
            .when(schema.startswith("ARRAY"), "array")
            .when(schema == "STRING", "string")
            .when(schema == "BOOLEAN", "boolean")
            .when(schema == "VOID", "null")
            .otherwise("number")
        )

    return let(F.schema_of_variant(value), lambda s: F.when(s.isNotNull(), name(s)))


def field_type(value: Column) -> Column:
    """Profile type of a JSON value; nested values count as string."""
    return let(kind(value), lambda k: F.when(k.isin("object", "array"), "string").otherwise(k))


def record_items(value: Column) -> Column:
    """The items of an array that holds only objects and nulls, else NULL."""
    return let(
        as_array(value),
        lambda items: F.when(
            F.forall(items, lambda i: is_object(i) | F.is_variant_null(i)), items
        ),
    )


def record_array(value: Column) -> Column:
    """``record_items`` as maps. A null item counts as a record without keys."""
    empty = F.create_map().cast(OBJECT)
    return F.transform(record_items(value), lambda i: F.coalesce(as_object(i), empty))


#: Bodies of strings, numbers, and the tokens of compact JSON.
_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_TOKEN = rf'"{_STRING}"|\{{\}}|\[\]|[{{}}\[\]:,]|[a-z]+'


def pretty(text: Column) -> Column:
    """The text as JSON with two blanks a level, members by name, numbers as they are written; NULL if it is not valid.

    Numbers would lose their form in a parsed value (``1.50``, ``1e3``), so they go through it as strings: strings get ``~`` in front, numbers
    become strings with ``~`` at their end, which tells them apart again.
    """
    marked = F.regexp_replace(text, rf'"({_STRING})"|({_NUMBER})', '"$2~$1"')
    compact = F.when(is_valid(text), F.to_json(F.try_parse_json(marked)))
    tokens = F.regexp_extract_all(compact, F.lit(_TOKEN), F.lit(0))
    step = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)

    def shown(t: Column, depth: Column) -> Column:
        line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))
        return (
            F.when(t.startswith('"~'), F.concat(F.lit('"'), F.substring(t, F.lit(3), F.length(t))))
            .when(t.startswith('"'), F.substring(t, F.lit(2), F.length(t) - 3))
            .when(t.isin("{", "[", ","), F.concat(t, line))
            .when(t.isin("}", "]"), F.concat(line, t))
            .when(t == ":", F.lit(": "))
            .otherwise(t)
        )

    def written(ts: Column) -> Column:
        depths = running_sums(F.transform(ts, step))
        return let(depths, lambda ds: F.array_join(F.transform(ts, lambda t, i: shown(t, F.get(ds, i))), ""))

    return let(tokens, lambda ts: F.when(ts.isNotNull(), written(ts)))


def skeleton(value: Column) -> Column:
    """Compact JSON with every text replaced by ``S`` and every empty text by ``E``.

    What is left holds only structure, so counting characters in it counts members at any depth
    in one linear pass, without walking levels.
    """
    marked = F.regexp_replace(F.to_json(value), r'(?<=[:,\[{])""', "E")
    return F.regexp_replace(marked, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "S")


def count_of(text: Column, needle: str) -> Column:
    """How often a fixed text occurs."""
    shrunk = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(shrunk)) / len(needle)).cast("int")


def object_nesting(value: Column) -> Column:
    """Depth of object nesting, an upper bound for walks over objects."""
    braces = F.regexp_replace(skeleton(value), "[^{}]", "")
    # Sibling records add nothing to the depth, so runs of them shrink first.
    thin = F.regexp_replace(F.regexp_replace(braces, r"(?:\{\})++", "{}"), r"(?:\{\{\}\})++", "{{}}")
    steps = F.filter(F.split(thin, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(steps, start, step, lambda acc: acc["top"])


def leaf_text(value: Column) -> Column:
    """Export text of a value: arrays and objects as JSON, null as empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


#: Levels of objects opened one by one before the depth of the whole value is taken.
_OPENED = 2


def flatten(value: Column) -> Column:
    """``array<struct<path, val>>``: dotted paths of an object's leaves; arrays stay whole."""
    def children(path: Column, members: Column) -> Column:
        return F.transform(
            F.map_entries(members),
            lambda m: F.struct(
                F.when(path == "", m["key"]).otherwise(F.concat_ws(".", path, m["key"])).alias("path"),
                m["value"].alias("val"),
            ),
        )

    def expand(entry: Column) -> Column:
        return let(
            as_object(entry["val"]),
            lambda members: F.when(members.isNull(), F.array(entry)).otherwise(children(entry["path"], members)),
        )

    def expanded(leaves: Column) -> Column:
        return F.flatten(F.transform(leaves, expand))

    def opened(leaves: Column, levels: int) -> Column:
        # The depth costs a walk over the whole text, which most values do not need.
        some = F.exists(leaves, lambda leaf: is_object(leaf["val"]))
        if levels:
            deeper = let(expanded(leaves), lambda more: opened(more, levels - 1))
        else:
            steps = F.sequence(F.lit(1), F.greatest(F.lit(1), object_nesting(value)))
            deeper = F.aggregate(steps, leaves, lambda acc, _: expanded(acc))
        return F.when(some, deeper).otherwise(leaves)

    def of_members(members: Column) -> Column:
        leaves = F.transform(F.map_entries(members), lambda m: F.struct(m["key"].alias("path"), m["value"].alias("val")))
        whole = F.array(F.struct(F.lit("").alias("path"), value.alias("val")))
        return let(F.when(members.isNull(), whole).otherwise(leaves), lambda top: opened(top, _OPENED - 1))

    return let(as_object(value), of_members)


def flat_map(value: Column) -> Column:
    """``map<string,string>`` of dotted path to text; of equal paths the last is kept.

    A value that is no object gives no entries.
    """
    def of_members(members: Column) -> Column:
        nested = F.exists(F.map_values(members), is_object)
        entries = F.transform(flatten(value), lambda leaf: F.struct(leaf["path"], leaf_text(leaf["val"])))
        return (
            F.when(members.isNull(), F.create_map().cast("map<string,string>"))
            .when(nested, F.map_from_entries(entries))
            .otherwise(F.transform_values(members, lambda _, v: leaf_text(v)))
        )

    return let(as_object(value), of_members)


def largest_array(value: Column) -> Column:
    """``struct<n, path, items>`` of the largest array of objects inside an object, outside other arrays.

    Items that are not objects are skipped. Of equally large arrays the smallest path wins.
    """
    def candidate(leaf: Column) -> Column:
        objects = F.filter(as_array(leaf["val"]), is_object)
        return let(
            objects,
            lambda r: F.struct(F.size(r).alias("n"), leaf["path"].alias("path"), r.alias("items")),
        )

    def better(best: Column, c: Column) -> Column:
        wins = (c["n"] > best["n"]) | ((c["n"] == best["n"]) & (c["n"] > 0) & (c["path"] < best["path"]))
        return F.when(wins, c).otherwise(best)

    none = F.struct(
        F.lit(0).alias("n"), F.lit("").alias("path"), F.array().cast(ARRAY).alias("items"),
    )
    arrays = F.filter(flatten(value), lambda leaf: as_array(leaf["val"]).isNotNull())
    found = F.aggregate(F.transform(arrays, candidate), none, better)
    return F.when(as_object(value).isNotNull(), found)


def depth(value: Column) -> Column:
    """Nesting depth of an object: nested object +1, array +1, first record of an array +2."""
    def expand(entry: Column) -> Column:
        def child(member: Column) -> Column:
            first = F.get(as_array(member), F.lit(0))
            inner = as_object(first)
            none = F.array().cast("array<struct<level:int,val:variant>>")
            made = lambda step, val: F.array(
                F.struct((entry["level"] + step).alias("level"), val.alias("val"))
            )
            return (
                F.when(as_object(member).isNotNull(), made(1, member))
                .when(inner.isNotNull(), made(2, first))
                .when(first.isNotNull(), made(1, F.lit(None).cast("variant")))
                .otherwise(none)
            )

        members = F.coalesce(F.map_values(as_object(entry["val"])), F.array().cast(ARRAY))
        return F.flatten(F.transform(members, child))

    start = F.struct(
        F.lit(1).alias("deepest"),
        F.array(F.struct(F.lit(1).alias("level"), value.alias("val"))).alias("open"),
    )

    def step(acc: Column, _: Column) -> Column:
        return let(
            F.flatten(F.transform(acc["open"], expand)),
            lambda nxt: F.struct(
                F.greatest(
                    acc["deepest"], F.coalesce(F.array_max(F.transform(nxt, lambda e: e["level"])), F.lit(1))
                ).alias("deepest"),
                F.filter(nxt, lambda e: e["val"].isNotNull()).alias("open"),
            ),
        )

    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), object_nesting(value))), start, step,
        lambda acc: acc["deepest"],
    )
    return F.when(as_object(value).isNotNull(), walk)
