"""Deterministic parsers for messy text: logs, key-value blocks, invoices, entities, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import jsontext, normalise
from quillgrid.functions.core import compact_texts, let, lines_of, run_counts, trim_ws, unfold
from quillgrid.session import materialise

# Patterns of log lines.
LOG_HEAD = r"^\[?(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:?\d{2})?\]?\s+([A-Z]+)\s+(.*)$"
LOG_REQUEST = r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)\s+(\d{3})(?:\s+(\d+)ms)?"
LOG_PAIR = r'([A-Za-z_][A-Za-z0-9_]*)=("[^"]*"|[^\s"]+)'

# What counts as an entity.
ENTITY_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"https?://[^\s<>\"')\]]+",
    "phone": r"(?:\+\d{1,3}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "amount": r"[$€£]\d[\d,]*(?:\.\d+)?",
    "date": r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-[A-Za-z]{3}-\d{4}",
    "id": r"[A-Z]{2,}-\d[\d-]*",
}
#: The same matches in linear time: within a run of local characters a match either starts at the run's start, or where the last match ended, or nowhere.
_LINEAR = {ENTITY_PATTERNS["email"]: r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"}


def pairs_of(text: Column, pattern: str) -> Column:
    """``map<string,string>`` of a two-group pattern; quotes around values are dropped."""
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.map_from_entries(
        F.zip_with(keys, values, lambda k, v: F.struct(k, F.btrim(v, F.lit('"'))))
    )


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_log(lines: DataFrame, line: str) -> DataFrame:
    """Adds the fields of a log line; ``is_entry`` is false where the line is not an entry.

    Every field is one expression on the line, so parsing is a single projection. ``ts`` is the stamp as written, or UTC where the
    stamp names its offset.
    """
    head = lambda g: F.regexp_extract(F.col(line), LOG_HEAD, g)
    request = lambda g: _or_null(F.regexp_extract(F.col("_rest"), LOG_REQUEST, g))
    split = lines.withColumn("_rest", head(4)).withColumn("_stamp", head(1)).withColumn("_zone", head(2))
    digits = F.translate("_zone", "+-:Z", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    ahead = F.coalesce(F.when(F.startswith("_zone", F.lit("-")), -minutes).otherwise(minutes), F.lit(0))
    stamp = F.translate(F.col("_stamp"), "/T", "- ").try_cast("timestamp_ntz") - F.make_dt_interval(mins=ahead)
    parsed = (
        split.withColumn("is_entry", F.col("_stamp") != "")
        .withColumn("ts", stamp)
        .withColumn("level", _or_null(head(3)))
        .withColumn("method", request(1))
        .withColumn("path", request(2))
        .withColumn("status", request(3).try_cast("int"))
        .withColumn("duration_ms", request(4).try_cast("int"))
        .withColumn("fields", pairs_of(F.col("_rest"), LOG_PAIR))
    )
    return (
        parsed.withColumn("error", F.try_element_at("fields", F.lit("err")))
        .withColumn("user_id", F.try_element_at("fields", F.lit("user_id")))
        .withColumn("amount", F.try_element_at("fields", F.lit("amount")).try_cast("double"))
        .withColumn(
            "message",
            F.when(
                F.col("is_entry") & F.col("method").isNull(),
                F.trim(F.regexp_replace("_rest", r"\s*" + LOG_PAIR, "")),
            ),
        )
        .drop("_rest", "_stamp", "_zone")
    )


def log_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines of log documents: ``doc_id, line_no, line``; blank lines dropped."""
    lines = unfold(df, [F.col(doc).alias("doc_id")], lines_of(F.col(text)), "line_no", "line")
    return lines.where(trim_ws(F.col("line")) != "")


def log_summary(entries: DataFrame, group: str, payment_path: str = "%/payments%") -> DataFrame:
    """Entry counts by level, error rate, payment failures and time range per group.

    Only counters cross the shuffle; distinct endpoints are counted as their own grouped rows.
    """
    failed = F.col("status") >= 400
    base = entries.where("is_entry").groupBy(group).agg(
        F.count(F.lit(1)).alias("total_entries"),
        *[F.count_if(F.col("level") == lv).alias(lv.lower()) for lv in ("INFO", "WARN", "ERROR")],
        F.count_if(failed).alias("failed"),
        F.count_if(failed & F.col("path").like(payment_path)).alias("payment_failures"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct("path").alias("unique_endpoints"),
    )
    return base.withColumn("error_percent", F.round(F.col("failed") * 100 / F.col("total_entries")).cast("int")).withColumn(
        "span_seconds",
        (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))).try_cast("bigint")
        / F.lit(1_000_000),
    )


def log_levels(entries: DataFrame, group: str) -> DataFrame:
    """Entries of each level, whatever its name: ``group, level, entries``."""
    return entries.where("is_entry").groupBy(group, "level").agg(F.count(F.lit(1)).alias("entries"))


def log_endpoints(entries: DataFrame, group: str) -> DataFrame:
    """The endpoints of a log: ``group, method, path, requests, failed``."""
    return entries.where("is_entry AND path IS NOT NULL").groupBy(group, "method", "path").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("failed")
    )


def transitions(entries: DataFrame, group: str, ts: str, state: Column) -> DataFrame:
    """Changes of a state over time: ``group, at, state``. Of states at one time the smallest comes first.

    A segmented scan. Rows with a state are dealt by ranges of (group, time, state) and stored; a range that falls within one group is as
    good as any other, so a group holding all rows spreads over all tasks. Each range is compared row by row; its last state is carried on
    to the next range of the group, one row for each.
    """
    rows = entries.select(F.col(group).alias("group"), F.col(ts).alias("at"), state.alias("state")).where(F.col("state").isNotNull())
    ranges = rows.repartitionByRange("group", "at", "state").withColumn("part", F.spark_partition_id())
    stored = materialise(ranges, "ranges")
    order = Window.partitionBy("group", "part").orderBy("at", "state")
    inner = stored.withColumn("before", F.lag("state").over(order))
    closing = stored.groupBy("group", "part").agg(F.max_by("state", F.struct("at", "state")).alias("closing"))
    opening = closing.select("group", "part", F.lag("closing").over(Window.partitionBy("group").orderBy("part")).alias("opening"))
    return (
        inner.join(opening, ["group", "part"])
        .withColumn("before", F.coalesce("before", "opening"))
        .where(F.col("before").isNull() | (F.col("before") != F.col("state")))
        .select("group", "at", "state")
    )


KEY_VALUE_PAIR = r"^([A-Za-z][A-Za-z0-9 _#-]*?):[ \t]*(.*)$"


def kv_blocks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Blocks of ``Key: value`` documents: ``doc_id, block, pairs, body``; blocks end at ``---``."""
    blocks = F.transform(F.split(F.col(text), r"(?:^|\n)---+[ \t]*(?:\n|$)", -1), trim_ws)
    exploded = unfold(
        df, [F.col(doc).alias("doc_id")], F.filter(blocks, lambda b: b != ""), "block", "_b"
    )
    is_pair = lambda l: l.rlike(KEY_VALUE_PAIR)
    lines = F.transform(lines_of(F.col("_b")), trim_ws)
    return exploded.withColumn("_l", lines).select(
        "doc_id", "block",
        F.map_from_entries(
            F.transform(
                F.filter("_l", is_pair),
                lambda l: F.struct(
                    F.regexp_extract(l, KEY_VALUE_PAIR, 1), trim_ws(F.regexp_extract(l, KEY_VALUE_PAIR, 2))
                ),
            )
        ).alias("pairs"),
        trim_ws(F.array_join(F.filter("_l", lambda l: ~is_pair(l)), "\n")).alias("body"),
    )


# Layout of invoices.
INVOICE_ITEM = (
    r"^\s*(\S.*?)\s{2,}([\d.,]+)(?:\s+([A-Za-z]+))?\s+[$€£]([\d.,]+)(?:/[A-Za-z]+)?\s+(?:[$€£]([\d.,]+)|(FREE))\s*$"
)


def _labelled(text: Column, label: str) -> Column:
    return _or_null(trim_ws(F.regexp_extract(text, rf"(?m)^[ \t]*{label}[ \t]*(.+?)[ \t]*$", 1)))


def _party(text: Column, label: str) -> Column:
    """The lines of a party block, from its label to the next blank line."""
    block = F.regexp_extract(text, rf"(?m)^{label}:[ \t]*((?:.+(?:\n|\z))+)", 1)
    return F.filter(F.transform(lines_of(block), trim_ws), lambda l: l != "")


def _money(text: Column) -> Column:
    return normalise.number(text)


def invoice(text: Column) -> Column:
    """An invoice as one struct: head, parties, line items, totals, payment, and a sum check."""
    return let(text, _invoice)


def _invoice(text: Column) -> Column:
    plain_lines = lambda ls: F.filter(ls, lambda l: ~l.rlike(r"^[A-Za-z ]+:"))
    labelled = lambda ls, label: _or_null(
        F.regexp_replace(F.get(F.filter(ls, lambda l: l.startswith(label)), F.lit(0)), rf"^{label}\s*", "")
    )

    def item(line: Column) -> Column:
        # One match per line: its groups are written out with a separator and split again.
        groups = F.split(F.regexp_replace(line, INVOICE_ITEM, "\x01".join(f"${i}" for i in range(1, 7))), "\x01", -1)
        return let(groups, of_groups)

    def of_groups(parts: Column) -> Column:
        g = lambda i: F.get(parts, F.lit(i - 1))
        return F.struct(
            g(1).alias("description"), _money(g(2)).alias("quantity"), _or_null(g(3)).alias("unit"),
            _money(g(4)).alias("unit_price"),
            F.when(g(6) == "FREE", F.lit(0.0)).otherwise(_money(g(5))).alias("amount"),
        )

    items = F.transform(F.filter(lines_of(text), lambda l: l.rlike(INVOICE_ITEM)), item)
    total = lambda label: _money(
        F.regexp_extract(text, rf"(?mi)^[ \t]*{label}[^\n$€£]*:[ \t]*[$€£]([\d.,]+)[ \t]*$", 1)
    )
    parties = {name: _party(text, label) for name, label in (("sender", "From"), ("recipient", "To"))}
    head = F.struct(
        _or_null(F.regexp_extract(text, r"(?i)invoice[ \t]*#[ \t]*(\S+)", 1)).alias("number"),
        normalise.date(_labelled(text, "Date:")).alias("date"),
        normalise.date(_labelled(text, "Due:")).alias("due_date"),
        _labelled(text, "PO#:").alias("purchase_order"),
        _labelled(text, "Payment Terms:").alias("payment_terms"),
    )
    sides = [
        let(
            lines,
            lambda ls: F.struct(
                F.get(ls, F.lit(0)).alias("company"),
                let(plain_lines(ls), lambda own: F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(0))), ", ")).alias("address"),
                labelled(ls, "Tax ID:").alias("tax_id"), labelled(ls, "Attn:").alias("attention"),
            ),
        ).alias(name)
        for name, lines in parties.items()
    ]
    totals = F.struct(
        total("Subtotal").alias("subtotal"),
        (_money(F.regexp_extract(text, r"(?i)tax \(([\d.]+)%\)", 1)) / 100).alias("tax_rate"),
        total("Tax").alias("tax"), total("Total").alias("total"),
    )
    payment = F.struct(
        _or_null(F.regexp_extract(text, r"Wire to:[ \t]*([^,\n]+)", 1)).alias("bank"),
        _or_null(F.regexp_extract(text, r"Acct#[ \t]*(\d+)", 1)).alias("account_number"),
        _or_null(F.regexp_extract(text, r"Routing#[ \t]*(\d+)", 1)).alias("routing_number"),
    )

    def checked(s: Column) -> Column:
        items_sum = F.round(
            F.aggregate(s["items"], F.lit(0.0), lambda a, i: a + F.coalesce(i["amount"], F.lit(0.0))), 2
        )
        return F.struct(
            head.alias("invoice"), *sides, s["items"].alias("line_items"), s["totals"].alias("totals"),
            payment.alias("payment"), items_sum.alias("items_sum"),
            (F.abs(items_sum - s["totals"]["subtotal"]) < 0.005).alias("reconciles"),
        )

    return let(F.struct(items.alias("items"), totals.alias("totals")), checked)


def entities(df: DataFrame, doc: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, kind, value, n, opens_kind``: entities of each document with their number of mentions.

    ``opens_kind`` marks one entity per document and kind. Counting happens inside the document's row;
    nothing is shuffled.
    """
    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col(text), F.lit(_LINEAR.get(pattern, pattern)), F.lit(0)),
            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")),
        )

    def marked(runs: Column) -> Column:
        return F.transform(
            runs,
            lambda r, i: F.struct(
                r["value"]["kind"].alias("kind"), r["value"]["value"].alias("value"), r["n"].alias("n"),
                ((i == 0) | (F.get(runs, i - 1)["value"]["kind"] != r["value"]["kind"])).alias("opens_kind"),
            ),
        )

    found = [tagged(kind, pattern) for kind, pattern in (patterns or ENTITY_PATTERNS).items()]
    listed = let(run_counts(F.concat(*found)), marked)
    return unfold(df, [F.col(doc).alias("doc_id")], listed, "_i", "e").select("doc_id", "e.*")


def entity_counts(found: DataFrame) -> DataFrame:
    """Mentions, distinct values and documents per kind, in one pass over the entities.

    A value mentioned everywhere shrinks to one row per task before the shuffle.
    """
    by_value = found.groupBy("kind", "value").agg(
        F.sum("n").alias("n"), F.count_if("opens_kind").alias("documents")
    )
    return by_value.groupBy("kind").agg(
        F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("distinct_values"),
        F.sum("documents").alias("documents"),
    )


def xml_records(df: DataFrame, doc: str, text: str, path: str, fields: list[str]) -> DataFrame:
    """Repeated elements of XML text as rows: one column of texts per field path (``name``, ``@id``, ``owner/name``).

    The text is parsed once, and each record keeps its own fields: an absent one is null, of a repeated one the first counts.
    Text that is not XML, or has another root, gives no rows.
    """
    root, *levels = path.strip("/").split("/")
    columns = [f.replace("@", "_").split("/") for f in fields]
    schema = _xml_struct(columns)
    for level in reversed(levels):
        schema = f"struct<`{level}`:array<{schema}>>"
    # A leading declaration, comments and a document type come before the root element.
    is_root = F.regexp_extract(F.col(text), r"^(?:\s|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<![^>]*>)*+<([^\s/>]+)", 1) == root
    parsed = df.select(F.col(doc).alias("doc_id"), F.when(is_root, F.from_xml(F.col(text), schema)).alias("_x"))
    items = F.array(F.col("_x"))
    for level in levels:
        items = F.flatten(F.array_compact(F.transform(items, lambda x: x[level])))
    rows = unfold(parsed, ["doc_id"], items, "record", "r")

    def value(at: Column, parts: list[str]) -> Column:
        name, *rest = parts
        if name.startswith("_"):
            return at[name]
        first = F.get(at[name], F.lit(0))
        return value(first, rest) if rest else first

    return rows.select("doc_id", "record", *[value(F.col("r"), c).alias(f.lstrip("@")) for c, f in zip(columns, fields)])


def _xml_struct(paths: list[list[str]]) -> str:
    """The type of an element with these paths below it; attributes (``_name``) are single, elements may repeat."""
    below: dict[str, list[list[str]]] = {}
    for name, *rest in paths:
        below.setdefault(name, []).extend([rest] if rest else [])
    kinds = {n: "string" if n.startswith("_") else f"array<{_xml_struct(p) if p else 'string'}>" for n, p in below.items()}
    return "struct<" + ", ".join(f"`{n}`:{k}" for n, k in kinds.items()) + ">"


def flat_json(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Nested JSON as ``doc_id, field, value`` rows, fields sorted within the document."""
    entries = F.array_sort(F.map_entries(jsontext.flat_map(jsontext.strict(F.col(text)))))
    return unfold(df, [F.col(doc).alias("doc_id")], entries, "_i", "e").select(
        "doc_id", F.col("e.key").alias("field"), F.col("e.value").alias("value")
    )


def markdown_rows(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Body rows of Markdown tables: ``doc_id, table, headers, row, cells``; any other line ends a table."""
    is_row = lambda l: l.rlike(r"^\s*\|.*\|\s*$")
    is_rule = lambda l: l.rlike(r"^\s*\|(?:[\s:-]+\|)+\s*$") & F.contains(l, F.lit("-"))

    def cells(line: Column) -> Column:
        inner = F.regexp_replace(trim_ws(line), r"^\||\|$", "")
        return F.transform(
            F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(trim_ws(c), F.lit(r"\|"), F.lit("|"))
        )

    # Other lines become empty ones, so that tables are what empty lines part.
    kept = F.array_join(F.transform(lines_of(F.col(text)), lambda l: F.when(is_row(l), l).otherwise("")), "\n")
    parts = F.filter(F.split(kept, "\n\n+", -1), lambda p: F.btrim(p, F.lit("\n")) != "")
    tables = F.transform(
        parts, lambda p: F.transform(F.filter(lines_of(p), lambda l: is_row(l) & ~is_rule(l)), cells)
    )
    parsed = unfold(df, [F.col(doc).alias("doc_id")], tables, "table", "_r")
    body = F.when(F.size("_r") > 1, F.slice("_r", 2, F.size("_r") - 1))
    return unfold(parsed, ["doc_id", "table", F.get("_r", F.lit(0)).alias("headers")], body, "row", "cells")


FENCE = r"```(\w*)\n([\s\S]*?)```"


def fenced_blocks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Fenced blocks: ``doc_id, block, lang, body, is_chart``. A chart's body may follow its mark without a line end."""
    told = F.replace(F.col(text), F.lit("```chart{"), F.lit("```chart\n{"))
    langs = F.regexp_extract_all(told, F.lit(FENCE), F.lit(1))
    bodies = F.regexp_extract_all(told, F.lit(FENCE), F.lit(2))
    zipped = F.arrays_zip(langs.alias("lang"), bodies.alias("body"))
    return (
        unfold(
            df.where(F.contains(F.col(text), F.lit("```"))), [F.col(doc).alias("doc_id")], zipped, "block", "b"
        ).select(
            "doc_id", "block", "b.lang", "b.body",
            ((F.col("b.lang") == "chart") & jsontext.is_valid(trim_ws(F.col("b.body")))).alias("is_chart"),
        )
    )


def normalise_people(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Messy ``name, age, city, salary, start_date, email`` rows cleaned, with an ``issues`` array."""
    c = F.col
    email = normalise.present(c("email"))
    return df.select(
        *[x for x in df.columns if x not in ("name", "age", "city", "salary", "start_date", "email")],
        normalise.present(c("name")).alias("name"),
        normalise.number(c("age")).cast("int").alias("age"),
        normalise.alias(normalise.present(c("city")), aliases).alias("city"),
        normalise.number(c("salary")).alias("salary"),
        normalise.date(c("start_date")).alias("start_date"),
        email.alias("email"),
        compact_texts(
            normalise.missing_issue("name", c("name")),
            normalise.number_issue("age", c("age")),
            normalise.number_issue("salary", c("salary")),
            normalise.date_issue(c("start_date")),
            normalise.email_issue(c("email")),
        ).alias("issues"),
        normalise.date_form(c("start_date")).alias("date_form"),
        normalise.number_form(c("salary")).alias("salary_form"),
    )


def people_summary(clean: DataFrame) -> DataFrame:
    """One row: rows, rows with issues, and missing values per column."""
    columns = ("name", "age", "city", "salary", "start_date", "email")
    return clean.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.size("issues") > 0).alias("issue_rows"),
        *[F.count_if(F.col(x).isNull()).alias(f"missing_{x}") for x in columns],
        F.array_sort(F.collect_set("date_form")).alias("date_forms"),
    )
