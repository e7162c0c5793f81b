"""Reading the JSON object in a free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A text in pieces: escaped characters, quotes, braces, and runs of anything else.
PIECES = r'(?s)\\.|["{}]|[^\\"{}]+|\\'
GREEDY = r"(?s)\{.*\}"


def object_spans(text: Column) -> Column:
    """Texts that may be an object: outermost balanced braces in order, then all from the first to the last brace.

    One pass over the text counts the depth of braces; braces in quoted text
    inside an object do not count. An open brace of the prose that is never
    closed hides what comes after it from the count; the last text is for that.
    """
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    none = F.array().cast("array<struct<start:int,size:int>>")
    state = F.struct(
        F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("start"), none.alias("spans")
    )

    def step(s: Column, piece: Column) -> Column:
        opens, closes = ~s["quoted"] & (piece == "{"), ~s["quoted"] & (piece == "}") & (s["depth"] > 0)
        span = F.struct(s["start"].alias("start"), (s["at"] - s["start"] + 1).alias("size"))
        return F.struct(
            (s["at"] + F.length(piece)).alias("at"),
            F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when((piece == '"') & (s["depth"] > 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["start"]).alias("start"),
            F.when(closes & (s["depth"] == 1), F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
        )

    found = F.aggregate(pieces, state, step, lambda s: F.transform(s["spans"], lambda x: F.substring(text, x["start"], x["size"])))
    greedy = F.regexp_extract(text, GREEDY, 0)
    return F.array_distinct(F.concat(found, F.when(greedy != "", F.array(greedy)).otherwise(F.array().cast("array<string>"))))


def text_of(value: Column, key: str) -> Column:
    """A member of an object as text, whatever it is; null where it is absent or null."""
    return F.try_variant_get(value, f"$.{key}", "string")


def number_of(value: Column, key: str) -> Column:
    """A number, or a text that reads as one, rounded to a whole number, halves up."""
    number = F.floor(F.try_variant_get(value, f"$.{key}", "double") + F.lit(0.5))
    return F.when(F.abs(number) < 1 << 31, number).cast("int")


def list_of(value: Column, key: str) -> Column:
    """A list of texts; a single value where a list is due is a list of one."""
    single = text_of(value, key)
    return F.coalesce(
        F.array_compact(F.try_variant_get(value, f"$.{key}", "array<string>")), F.when(single.isNotNull(), F.array(single))
    )


def readable(text: Column) -> Column:
    """A JSON object, or null."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def first_missing(fields: Column, required: Sequence[str]) -> Column:
    """Name of the first required field that is null, or null."""
    return F.coalesce(*[F.when(fields[key].isNull(), F.lit(key)) for key in required])
