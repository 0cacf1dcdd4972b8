import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import csvtext, text
from quillgrid.functions.core import head_lines
from tests import fixtures as fx


PLAIN = "nothing to see here"


def lines(n, kind, m=0):
    """``n`` lines of a kind, then ``m`` plain ones."""
    one = {"stamp": "2031/05/02T07:00 pump {i} on", "heading": "## part {i}", "pair": "Pump {i}:   idle"}[kind]
    return "\n".join([one.format(i=i) for i in range(n)] + [PLAIN] * m)


@pytest.mark.parametrize("body, kind", [
    # More than half of the lines with stamps, more than a third with pairs, two headings.
    (lines(5, "stamp", 4), "log"), (lines(5, "stamp", 5), "unknown"), (lines(4, "pair", 8), "unknown"), (lines(5, "pair", 8), "key_value"),
    (lines(2, "heading", 70), "markdown"), (lines(1, "heading", 3), "unknown"),
    # Rules in order: stamps before headings before pairs.
    (lines(3, "stamp") + "\n" + lines(2, "heading"), "log"), (lines(2, "heading") + "\n" + lines(9, "pair"), "markdown"),
    # All lines count, also far below.
    (PLAIN + "\n" + (PLAIN + "\n") * 40 + lines(60, "stamp"), "log"), (lines(12, "pair") + ("\n" + PLAIN) * 60, "unknown"),
    # Lines are trimmed; a pair needs its value on the same line.
    ("\u3000 " + lines(1, "stamp") + " \r\n\t" + lines(1, "stamp"), "log"), ("Pump:\nPump:\n\nidle", "unknown"), ("Pump:\u00a0idle", "unknown"),
    # JSON must be whole; markup opens with a tag.
    (" [ ] ", "json"), ("[0, 1", "unknown"), ("{}{}", "unknown"), ("null", "unknown"), ("<b>bold</b> and more", "xml"), ("< b", "unknown"), ("<?xml", "xml"),
    # Tabs in the first line only; quotes hold commas and line ends.
    ("x\ty\nz", "csv"), ("x\ny\tz", "unknown"), ('"p,q",r\n1,2', "csv"), ('p"q,r\n1,2', "unknown"), ("p,q\n1,2,3", "csv"), ("p,q\n1,2,3,4", "unknown"),
    ("\u2003\n\x85", "unknown"), (fx.STATEMENT, "unknown"), (fx.INVOICE, "key_value"), (fx.TICKETS, "key_value"), (fx.NESTED, "json"), (fx.LOG, "log"), (fx.PEOPLE, "csv"),
])
def test_doc_type(column, body, kind):
    assert column(text.doc_type, [body]) == [kind]


def test_doc_type_of_the_first_lines(column):
    late = PLAIN + ("\n" + PLAIN) * 40 + "\n" + lines(60, "stamp")
    early = lines(12, "pair") + ("\n" + PLAIN) * 60
    assert column(lambda c: text.doc_type(c, (20, 30)), [late, early, lines(11, "stamp", 90), lines(10, "stamp", 90)]) == ["unknown", "key_value", "log", "unknown"]


def test_classify_value(column):
    cases = {
        "number": ["0", "-3.", "+.5", "6E-2", "£7".replace("£", "$"), "€1,200,300", "$€5", "+Inf", "infinity", "nan", "0X1.8p-3", "1,,2"],
        "date": ["2031/05/02 and more", "31-12-2031", "02/05/2031", "09-Feb-1999", "Smarch 40, 2022", "May 7 1990"],
        "email": ["a.b+c@d-e.co", "x_%@y.zz"], "url": ["http://", "https://h/p?q=1"], "boolean": ["tRuE", "False"],
        "string": ["", " ", "£5", "1_000", "1d", "0x12", "e5", "--1", "x@y", "a@b.c", "ftp://h", "yes", "1999-1-2", "$"],
    }
    flat = [(v, kind) for kind, values in cases.items() for v in values]
    assert list(zip([v for v, _ in flat], column(text.classify_value, [v for v, _ in flat]))) == flat


def test_tokenize(column):
    got = column(text.tokenize, ["One, two! THREE-4 five.", "né 3x"])
    assert got == [["one", "two", "three", "4", "five"], ["n", "3x"]]


def test_sentences(column):
    got = column(text.split_sentences, ["One. Two! Three?Four. ", "a.\n b", "x"])
    assert got == [["One.", "Two!", "Three?Four.", ""], ["a.", "b"], ["x"]]


def naive_chunks(t, size):
    """Plain restatement of greedy packing, over pieces that may not be cut."""
    t = t.strip()
    if not t:
        return []
    if len(t.encode()) <= size:
        return [t]
    pieces = []
    for p in (x.strip() for x in t.split("\n\n")):
        if not p:
            continue
        if len(p.encode()) <= size:
            pieces.append((p, "\n\n", False))
        else:
            parts = re.split(r"(?<=[.!?\n])(?= )", p)
            pieces += [(s.strip(), " ", i == 0) for i, s in enumerate(parts)]
    done, cur = [], ""
    for body, sep, force in pieces:
        if cur and (force or len(cur.encode()) + len(body.encode()) + len(sep) > size):
            done.append(cur.strip())
            cur = body
        else:
            cur = cur + sep + body if cur else body
    return done + [cur.strip()] if cur else done


def test_chunk_edges(column):
    """At the target, one byte over it, and where bytes are not characters."""
    docs = ["\u00e9" * 25, "\u00e9" * 25 + "!", "a" * 24 + "\n\n" + "b" * 24, "a" * 25 + "\n\n" + "b" * 24, "\n\n".join("cde"), "\u3000\n\n ", "Up. " + "d" * 60 + ". On."]
    got = column(lambda c: text.chunk_text(c, 50), docs)
    assert got == [[docs[0]], [docs[1]], [docs[2]], ["a" * 25, "b" * 24], [docs[4]], [], ["Up.", "d" * 60 + ".", "On."]]


def test_chunks_match_plain_loop(column):
    rng = random.Random(5)
    words = ["alpha", "bé", "cc", "longerword", "ü", "x."]
    docs = []
    for _ in range(60):
        n = rng.randint(0, 80)
        docs.append(
            "".join(rng.choice(words) + rng.choice([" ", ". ", "! ", "\n", "\n\n", "\n\n\n ", ".\n ", "  "]) for _ in range(n))
        )
    got = column(lambda c: text.chunk_text(c, 60), docs)
    assert got == [naive_chunks(d, 60) for d in docs]
    for doc, chunks in zip(docs, got):
        assert re.sub(r"\s", "", doc) == re.sub(r"\s", "", "".join(chunks))


def test_significant_tokens(column):
    got = column(text.significant_tokens, ['paid $45, on 2024-01-02 to "a@b" (12) 7 123, 123 é@', ""])
    assert got == [["$45", "2024-01-02", "a@b", "123", "é@"], []]


def test_currency_cells(column):
    got = column(text.currency_cells, ["$85,000,x\n €5 ,£1.50,$,5", "none"])
    assert got == [3, 0]


@pytest.mark.parametrize("repair", [True, False])
def test_csv_records_match_csv_module(column, repair):
    import csv
    import io

    rng = random.Random(3)
    cell = lambda: rng.choice(["a", "b c", "x,y", 'say ""hi""', "two\nlines", "", "é"])
    docs, want = [], []
    for _ in range(40):
        width = rng.randint(1, 4)
        rows = []
        for _ in range(rng.randint(1, 6)):
            row = []
            for _ in range(width):
                v = cell()
                quote = any(x in v for x in ',\n"') or rng.random() < 0.2
                row.append(f'"{v}"' if quote else v)
            rows.append(",".join(row))
        doc = "\n".join(rows)
        docs.append(doc)
        want.append([[f.strip() for f in r] for r in csv.reader(io.StringIO(doc)) if r])
    got = column(lambda c: csvtext.records(c, repair=repair), docs)
    # A record holding one quoted empty field is not a blank line; one unquoted empty field is.
    plain = [[r for r in rows if r != [""]] for rows in got]
    assert plain == [[r for r in rows if r != [""]] for rows in want]


def test_csv_repair_and_tabs(column):
    got = column(csvtext.records, ["n,s\nA,$85,000\nB,$1,234,567\nC,5", "a\tb\n1\t2"])
    assert got[0] == [["n", "s"], ["A", "$85000"], ["B", "$1234567"], ["C", "5"]]
    assert got[1] == [["a", "b"], ["1", "2"]]


def test_amounts_of_any_number_of_groups(column):
    from quillgrid.functions import csvtext

    assert column(csvtext.repair_amounts, ["x,$1,234,567,890,123,y", "$85,000,€1,5"]) == ["x,$1234567890123,y", "$85000,€1,5"]


def test_bracketed_log_lines_are_not_parsed_as_json(spark):
    # A failed parse throws, which costs several times what the rules on lines do; a line that opens a bracket and never ends in one is no JSON.
    line = F.concat(F.lit("[2024-01-02 03:04:05.678] INFO POST /api/view 200 12ms user_id="), F.col("id").cast("string"))
    docs = {
        "open": spark.range(0, 400_000, 1, 4).select(line.alias("t")),
        "bare": spark.range(0, 400_000, 1, 4).select(F.substring(line, 2, 1000).alias("t")),
    }
    kind = text.doc_type(F.col("t"), K.TYPE_WINDOW)
    assert [d.limit(1).select(kind.alias("k")).first()["k"] for d in docs.values()] == ["log", "log"]

    def seconds(df):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            df.select(kind).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    bare = seconds(docs["bare"])
    assert seconds(docs["open"]) < 1.6 * bare


def test_head_lines_match_the_lines_of_the_whole_text(column):
    texts = ["", "a", "a\n", "\n", "\n\n", "a\nb", "a\nb\n", "a\nb\nc\nd", None]
    want = [None if t is None else t.split("\n")[:2] for t in texts]
    assert column(lambda c: head_lines(c, 2), texts) == want
