"""Differences between two copies of a table, field by field.

The sides are tagged and united, grouped once by key into one struct per side, and the structs compared
by a generated higher-order expression, so one shuffle serves all fields.

Defined results: rows with a blank key part are left out; of several rows of a key on one side the latest (by
``latest``, then the greatest) counts; a key that only one side has gives one row with field ''; two
empty tables give none. A hot key is reduced to one struct per side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import NUMBER, norm

RTOL, ATOL = 1e-10, 1e-12
# fixed values: texts that mean a missing number
MISSING = ("", "na", "nan", "null")


def as_number(text: Column) -> Column:
    """The number in a text, infinities included; null when there is none."""
    t = F.lower(F.trim(text))
    inf = F.when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).otherwise(inf)


def numbers_differ(a: Column, b: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Whether a number and a text of one differ; missing ones match only each other."""
    none_a = a.isNull() | F.isnan(a)
    none_b = b.isNull() | F.lower(F.trim(b)).isin(*MISSING)
    n = as_number(b)
    inf = float("inf")
    apart = F.abs(a - n) > F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(n)), F.lit(atol))
    return F.when(none_a | none_b, none_a != none_b).when(n.isNull(), F.lit(True)).when((F.abs(a) == inf) | (F.abs(n) == inf), a != n).otherwise(apart)


def texts_differ(a: Column, b: Column) -> Column:
    return norm(a) != norm(b)


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], numbers: list[str], texts: list[str], latest: str | None = None, left_name: str = "results", right_name: str = "copy") -> DataFrame:
    """keys, field, kind: missing_in_<right>, missing_in_<left> or differs. ``right`` holds texts only."""
    fields = [*numbers, *texts]
    a = F.struct(*([F.col(latest).alias("_at")] if latest else []), *[F.col(c).cast("double").alias(c) for c in numbers], *texts)
    b = F.struct(*[F.col(c).cast("string").alias(c) for c in fields])
    key = [F.trim(k).alias(k) for k in keys]
    lt = left.select(*key, a.alias("l"))
    rt = right.select(*key, b.alias("r"))
    both = lt.withColumn("r", F.lit(None).cast(rt.schema["r"].dataType)).unionByName(rt.withColumn("l", F.lit(None).cast(lt.schema["l"].dataType)))
    for k in keys:
        both = both.where(F.col(k) != "")
    grouped = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    checks = F.array(*[F.struct(F.lit(c).alias("field"), (numbers_differ if c in numbers else texts_differ)(F.col(f"l.{c}"), F.col(f"r.{c}")).alias("differs")) for c in fields])
    found = (
        F.when(F.col("r").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit(f"missing_in_{right_name}").alias("kind"))))
        .when(F.col("l").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit(f"missing_in_{left_name}").alias("kind"))))
        .otherwise(F.transform(F.filter(checks, lambda x: x["differs"]), lambda x: F.struct(x["field"].alias("field"), F.lit("differs").alias("kind"))))
    )
    return grouped.select(*keys, F.explode(found).alias("f")).select(*keys, "f.field", "f.kind")
