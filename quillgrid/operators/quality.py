"""Quality score of structured output against its raw text.

Everything is one projection per document: parsed values, token sets and key sets never leave
their row, so scoring any number of documents needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import jsontext
from quillgrid.functions.core import compact_texts, let, percent
from quillgrid.functions.text import significant_tokens


def clamp(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int")


def completeness(value: Column) -> Column:
    """Share of object members at any depth that are neither null nor an empty text."""
    def score(s: Column) -> Column:
        members = jsontext.count_of(s, ":")
        missing = jsontext.count_of(s, ":null") + jsontext.count_of(s, ":E")
        return F.when(members == 0, 50).otherwise(clamp(100 - percent(missing, members)))

    return let(jsontext.skeleton(value), score)


def record_consistency(rows: Column) -> Column:
    """Mean share of the first record's keys found in each later record."""
    first = F.map_keys(F.get(rows, F.lit(0)))

    def score(keys: Column) -> Column:
        shares = F.transform(
            F.slice(rows, 2, F.size(rows) - 1),
            lambda r: F.when(F.size(keys) == 0, 0).otherwise(
                percent(F.size(F.array_intersect(keys, F.map_keys(r))), F.size(keys))
            ),
        )
        total = F.aggregate(shares, F.lit(0), lambda a, x: a + x)
        return clamp(F.floor(total / (F.size(rows) - 1)))

    return let(first, score)


def naming_consistency(keys: Column) -> Column:
    """50 plus half the share of the dominant naming style, snake or camel."""
    def score(s: Column) -> Column:
        dominant = F.greatest(s["snake"], s["camel"])
        return F.when(s["total"] == 0, 70).otherwise(clamp(50 + F.floor(dominant * 50 / s["total"])))

    snake = F.filter(keys, lambda k: F.contains(k, F.lit("_")))
    camel = F.filter(keys, lambda k: ~F.contains(k, F.lit("_")) & k.rlike("^[a-z]"))
    return let(
        F.struct(
            F.size(snake).alias("snake"), F.size(camel).alias("camel"), F.size(keys).alias("total"),
        ),
        score,
    )


def consistency(value: Column) -> Column:
    """Of the records, else of the record array under the smallest key, else of the naming."""
    def in_object(members: Column) -> Column:
        nested = F.filter(
            F.transform(
                F.array_sort(F.map_keys(members)),
                lambda k: jsontext.record_array(F.try_element_at(members, k)),
            ),
            lambda rows: F.size(rows) > 1,
        )
        return let(
            F.get(nested, F.lit(0)),
            lambda rows: F.when(rows.isNotNull(), record_consistency(rows)).otherwise(
                naming_consistency(F.map_keys(members))
            ),
        )

    def of_rows(rows: Column) -> Column:
        return F.when(F.size(rows) > 1, record_consistency(rows)).otherwise(
            let(
                jsontext.as_object(value),
                lambda m: F.when(m.isNotNull(), in_object(m))
                .when(F.is_variant_null(value), 70)
                .otherwise(60),
            )
        )

    return let(jsontext.record_array(value), of_rows)


def structure(value: Column) -> Column:
    """Score of the shape: nesting and arrays count for more than flat values."""
    def member_traits(m: Column) -> Column:
        inner = jsontext.as_object(m)
        items = jsontext.as_array(m)
        first = F.get(items, F.lit(0))
        return F.struct(
            items.isNotNull().alias("is_array"),
            # Two levels: any nested object or any array with items.
            (inner.isNotNull() | first.isNotNull()).alias("two"),
            # Three levels: records in an array, or a nested object that is itself two levels deep.
            (
                jsontext.as_object(first).isNotNull()
                | F.coalesce(
                    F.exists(
                        F.map_values(inner),
                        lambda v: jsontext.as_object(v).isNotNull()
                        | F.get(jsontext.as_array(v), F.lit(0)).isNotNull(),
                    ),
                    F.lit(False),
                )
            ).alias("three"),
        )

    def two_levels(members: Column) -> Column:
        return F.exists(F.map_values(members), lambda m: member_traits(m)["two"])

    def of_object(members: Column) -> Column:
        def score(traits: Column) -> Column:
            arrays = F.exists(traits, lambda t: t["is_array"])
            return (
                F.when(F.size(traits) == 0, 20)
                .when(arrays & F.exists(traits, lambda t: t["three"]), 95)
                .when(arrays, 85)
                .when(F.exists(traits, lambda t: t["two"]), 75)
                .otherwise(60)
            )

        return let(F.transform(F.map_values(members), member_traits), score)

    def of_array(items: Column) -> Column:
        first = jsontext.as_object(F.get(items, F.lit(0)))
        return F.when(F.size(items) == 0, 30).otherwise(
            let(
                first,
                lambda f: F.when(f.isNull(), 55).when(two_levels(f), 95).otherwise(85),
            )
        )

    return let(
        F.struct(jsontext.as_array(value).alias("items"), jsontext.as_object(value).alias("members")),
        lambda s: F.when(s["items"].isNotNull(), of_array(s["items"]))
        .when(s["members"].isNotNull(), of_object(s["members"]))
        .otherwise(30),
    )


def leaf_tokens(value: Column) -> Column:
    """Text of a JSON value with its punctuation opened up, for comparing single values."""
    return F.regexp_replace(F.to_json(value), r'["\[\]{},]|(?<=["\d\w]):(?=\S)', " ")


def validity(raw: Column, structured: Column) -> Column:
    """Share of the raw text's significant tokens found in the structured text."""
    def score(s: Column) -> Column:
        found = F.size(F.array_intersect(s["raw"], s["out"]))
        return F.when(F.size(s["raw"]) == 0, 60).otherwise(clamp(percent(found, F.size(s["raw"]))))

    tokens = F.struct(
        significant_tokens(raw).alias("raw"), significant_tokens(structured).alias("out")
    )
    return F.when(raw == "", 60).otherwise(let(tokens, score))


def with_quality(
    df: DataFrame, raw: str, structured: str, mode: str = "text", to: str = "quality"
) -> DataFrame:
    """Adds a struct ``score, grade, status, breakdown, suggestions``.

    ``mode="text"`` compares white-space words, as the score is defined; ``mode="leaf"`` opens up
    JSON punctuation first, which is fairer to compact JSON.
    """
    if mode not in ("text", "leaf"):
        raise ValueError(f"unknown validity mode: {mode}")
    names = tuple(K.QUALITY_WEIGHTS)
    parsed = df.withColumn("_v", jsontext.strict(F.col(structured)))
    other = leaf_tokens(F.col("_v")) if mode == "leaf" else F.col(structured)
    scored = parsed.withColumn(
        "_parts",
        F.struct(
            completeness(F.col("_v")).alias("completeness"),
            consistency(F.col("_v")).alias("consistency"),
            validity(F.coalesce(F.col(raw), F.lit("")), other).alias("validity"),
            structure(F.col("_v")).alias("structure"),
        ),
    )
    state = F.when(F.coalesce(F.col(structured), F.lit("")) == "", "pending").when(F.col("_v").isNull(), "invalid").otherwise("scored")
    flat = F.struct(*[F.lit(0).alias(n) for n in names])
    bad = F.struct(*[F.lit(25).alias(n) for n in names])
    rated = scored.withColumn("_state", state).withColumn(
        "_parts",
        F.when(F.col("_state") == "pending", flat)
        .when(F.col("_state") == "invalid", bad)
        .otherwise(F.col("_parts")),
    )
    weighted = sum((F.col(f"_parts.{n}") * w for n, w in K.QUALITY_WEIGHTS.items()), F.lit(0))
    rated = rated.withColumn("_score", F.floor(weighted / 100).cast("int"))
    grade = F.lit(K.LOWEST_GRADE)
    for floor, name in reversed(K.GRADES):
        grade = F.when(F.col("_score") >= floor, name).otherwise(grade)
    advice = compact_texts(
        F.when(F.col("_parts.completeness") < 80, K.ADVICE_COMPLETENESS),
        F.when(F.col("_parts.consistency") < 70, K.ADVICE_CONSISTENCY),
        F.when(F.col("_parts.validity") < 70, K.ADVICE_VALIDITY),
        F.when(F.col("_parts.structure") < 70, K.ADVICE_STRUCTURE),
    )
    suggestions = (
        F.when(F.col("_state") == "pending", F.array(F.lit(K.ADVICE_PENDING)))
        .when(F.col("_state") == "invalid", F.array(F.lit(K.ADVICE_INVALID)))
        .when((F.size(advice) == 0) & (F.col("_score") >= 85), F.array(F.lit(K.ADVICE_GOOD)))
        .otherwise(advice)
    )
    quality = F.struct(
        F.col("_score").alias("score"),
        F.when(F.col("_state") == "pending", "-").when(F.col("_state") == "invalid", K.LOWEST_GRADE)
        .otherwise(grade).alias("grade"),
        F.when(F.col("_state") == "pending", "pending").otherwise("scored").alias("status"),
        F.col("_parts").alias("breakdown"),
        suggestions.alias("suggestions"),
    )
    return rated.withColumn(to, quality).drop("_v", "_parts", "_state", "_score")
