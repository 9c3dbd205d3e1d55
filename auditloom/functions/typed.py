"""Typed identity of mixed scalars: true, 1 and "1" are three levels; 1 and 1.0 are one."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def json_kind(json_text: Column) -> Column:
    """bool, num, str, object, array, missing of a JSON value's text."""
    t = F.trim(json_text)
    first = F.substring(t, 1, 1)
    return F.when(t.isNull() | (t == "null") | (t == ""), "missing").when(t.isin("true", "false"), "bool").when(first == '"', "str").when(first == "{", "object").when(first == "[", "array").otherwise("num")


def variant_key(v: Column) -> Column:
    """``kind|value`` of a variant scalar; all missing values are one key."""
    kind = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    num = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | (kind == "VOID"), "missing|")
        .when(kind == "BOOLEAN", F.concat(F.lit("bool|"), F.try_variant_get(v, "$", "string")))
        .when(kind == "STRING", F.concat(F.lit("str|"), F.try_variant_get(v, "$", "string")))
        .when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.concat(F.lit("num|"), F.when((num == F.floor(num)) & (F.abs(num) < 1e15), num.cast("long").cast("string")).otherwise(num.cast("string"))))
        .otherwise(F.concat(kind, F.lit("|"), F.to_json(v)))
    )


def key_equals(key: Column, literal_key: str) -> Column:
    """Typed equality; a missing value matches nothing."""
    return F.coalesce((key == F.lit(literal_key)) & (key != "missing|"), F.lit(False))


def display_label(key: Column) -> Column:
    """The value, with its kind in brackets where another level of the column looks the same."""
    shown = F.substring_index(key, "|", -1)
    n = F.count(F.lit(1)).over(Window.partitionBy(shown))
    return F.when(n > 1, F.concat(shown, F.lit(" ["), F.substring_index(key, "|", 1), F.lit("]"))).otherwise(shown)


def number(text: Column) -> Column:
    """A number from text as a data frame library reads it: blanks trimmed, no suffixes or separators; anything else is null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double")).when(F.lower(t).rlike(r"^[+-]?inf(inity)?$"), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def integer(text: Column) -> Column:
    """A whole number, by way of a double; null where there is a fraction."""
    x = number(text)
    return F.when((F.abs(x) < 9e15) & (x == F.floor(x)), F.floor(x))
