"""Forms, clusters and learned aliases against plain restatements."""

import random
import re

import pytest

from quillgrid.operators import forms, profile


def frame(spark, counts):
    return spark.createDataFrame([("f", v, n) for v, n in counts.items()], "field string, value string, n bigint")


def test_form(column):
    cases = {"$85,000": "$9,9", " ab  CD1 ": "a A9", "NewYork": "AaAa", "é-É 3x": "a-A 9a", "日本 7": "a 9", "": "", "2024-01-02": "9-9-9"}
    assert column(forms.form, list(cases)) == list(cases.values())


def test_forms_are_counted(spark):
    got = forms.forms(frame(spark, {"12": 3, "7": 1, "$5": 2, "n/a": 9, "": 4, "x": 1}))
    assert {(r.form, r.n, r["values"]) for r in got.collect()} == {("9", 4, 2), ("$9", 2, 1), ("a", 1, 1)}


def words_of(v):
    return re.sub(r"[^\w\s]|_", "", v.strip().lower()).split()


def key_of(v):
    return " ".join(sorted(set(words_of(v))))


def one_edit(a, b):
    """Whether one insertion, deletion, change or swap of neighbours leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_aliases(counts, ratio=3):
    shown = {v: n for v, n in counts.items() if v.lower() not in ("", "null", "n/a", "not_available")}
    groups = {}
    for v, n in shown.items():
        groups.setdefault(key_of(v) if re.search(r"[^\W\d_]", v) else v, []).append((-n, v))
    head = {k: (min(g)[1], -sum(n for n, _ in g)) for k, g in groups.items()}
    out = {}
    for k, g in groups.items():
        to, why = head[k][0], "writing"
        near = [h for h in head if one_edit(k, h) and head[h][1] >= ratio * head[k][1] and len(k) >= 5 and len(h) >= 5 and re.search(r"[^\W\d_]", k) and re.search(r"[^\W\d_]", h)]
        full = [h for h in head if 2 <= len(words_of(head[h][0])) <= 5 and "".join(w[0] for w in words_of(head[h][0])) == k]
        full.sort(key=lambda h: (-head[h][1], h))
        if re.fullmatch(r"[^\W\d_]{2,5}", k) and full and head[full[0]][1] >= ratio * sum(head[h][1] for h in full[1:]):
            to, why = head[full[0]][0], "initials"
        elif near:
            to, why = head[min(near, key=lambda h: (-head[h][1], h))][0], "spelling"
        for n, v in g:
            if v != to:
                out[v] = (to, -n, why)
    return out


def got_aliases(spark, counts):
    return {r.value: (r.alias, r.n, r.reason) for r in forms.learned_aliases(frame(spark, counts)).collect()}


def test_aliases(spark):
    counts = {"Lower Dale": 50, "lower dale": 3, "Dale, Lower": 2, "LOWER DALE.": 1, "Lower Dlae": 2, "Lwoer Dale": 1, "ld": 4, "Corby": 30, "Corrby": 4, "Corbi": 11, "Corby": 30,
              "12345": 9, "12346": 90, "1.50": 7, "150": 2, "n/a": 50, "--": 3, "-": 2, "Hill Marsh": 20, "HM": 5, "High Moor": 2, "abcd": 1, "abce": 40, "Tetford": 9, "Tteford": 3, "é clair": 8, "eclair": 1}
    got = got_aliases(spark, counts)
    assert got == plain_aliases(counts)
    assert got["ld"] == ("Lower Dale", 4, "initials") and got["Corrby"] == ("Corby", 4, "spelling") and "Corbi" not in got and got["HM"][0] == "Hill Marsh" and "12345" not in got


@pytest.mark.parametrize("seed", range(3))
def test_aliases_of_random_values(spark, seed):
    rng = random.Random(seed)
    words = ["stone", "stoen", "stne", "store", "stored", "tower", "towers", "towre", "Tower", "tower!"]
    counts = {}
    for _ in range(160):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "s", "st"])
        counts["".join(w) if rng.random() < 0.7 else "".join(w) + " " + rng.choice(words)] = rng.randint(1, 60)
    assert got_aliases(spark, counts) == plain_aliases(counts)


def test_aliases_are_used(spark):
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(["Oslo"] * 5 + ["oslo ", None, "Bergen", "OSLO", "bergen", "Bergen"])], "id int, city string, value string")
    aliases = forms.learned_aliases(profile.value_counts(df, "id", ["city", "value"]))
    rows = forms.with_aliases(df, ["city"], aliases).orderBy("id").collect()
    assert [r.city for r in rows] == ["Oslo"] * 6 + [None, "Bergen", "Oslo", "Bergen", "Bergen"] and rows[0].value == "k"
    assert forms.with_aliases(df.limit(0), ["city"], aliases).count() == 0


def test_column_quality(spark):
    df = spark.createDataFrame([(1, "$4,000", "2024-01-02"), (2, "12.5", "01/02/2024"), (3, "n/a", ""), (4, "four", "soon"), (5, "3", None)], "id int, pay string, day string")
    got = {r.field: r for r in forms.column_quality(profile.value_counts(df, "id", ["pay", "day"])).collect()}
    assert (got["pay"].total, got["pay"].missing, got["pay"].numbers, got["pay"].number_forms) == (5, 1, 3, ["$9,9", "9", "9.9"])
    assert (got["day"].missing, got["day"].dates, got["day"].date_forms) == (2, 2, ["MM/DD/YYYY", "YYYY-MM-DD"])
