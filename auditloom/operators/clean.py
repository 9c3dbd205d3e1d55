"""Profiles, cleaning by first matching rule, and replicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.quantiles import quantiles
from auditloom.scratch import Scratch


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, missing, missing_fraction, distinct_values of each column (all of them by default).

    Values are counted in long form: one narrow row a column and value, combined before the shuffle.
    """
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("e")).select("e.column", "e.v")
    per = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
    out = per.groupBy("column").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct_values"))
    return out.select("column", "n", "missing", (F.col("missing") / F.col("n")).alias("missing_fraction"), "distinct_values")


def profile_numbers(df: DataFrame, columns: list[str], scratch: Scratch | None = None) -> DataFrame:
    """column, n, min, q1, median, mean, q3, max, sd; quantiles are exact and range-partitioned."""
    scratch = scratch or Scratch(df.sparkSession, "profile")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.column", "e.v").where("v is not null and not isnan(v)")
    basic = long.groupBy("column").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_samp("v").alias("sd"))
    q = quantiles(long, ["column"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, scratch)
    return basic.join(q, "column")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """value, n, rank of the k most frequent values (ties by value)."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "value")).cast("long"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, distinct_rows, duplicates (null equals null)."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def first_rule(df: DataFrame, rules: list[tuple[str, Column]], out: str = "rule_id") -> DataFrame:
    """Adds the id of the first rule that rejects a row (null: the row is clean). A rule that is null doesn't reject."""
    case = reduce(lambda acc, r: acc.when(F.coalesce(r[1], F.lit(False)), F.lit(r[0])), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(False)), F.lit(rules[0][0])))
    return df.withColumn(out, case)


def sensitivity_mask(column: str, op: str, value: object = None) -> Column:
    """A filter operator: negated ones (ne, not_in) hold for missing rows; comparisons with a missing one don't."""
    c = F.col(column)
    no = lambda x: F.coalesce(x, F.lit(False))
    ops = {
        "eq": lambda: no(c == F.lit(value)), "ne": lambda: ~no(c == F.lit(value)), "in": lambda: no(c.isin(*value)), "not_in": lambda: ~no(c.isin(*value)),
        "isna": lambda: c.isNull(), "notna": lambda: c.isNotNull(), "lt": lambda: no(c < F.lit(value)), "le": lambda: no(c <= F.lit(value)), "gt": lambda: no(c > F.lit(value)), "ge": lambda: no(c >= F.lit(value)),
    }
    return ops[op]()


def exclude_any(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Drops a row when any rule holds."""
    return df.where(~reduce(lambda a, b: a | b, [sensitivity_mask(*r) for r in rules]))


def replicates(df: DataFrame, key: list[str], values: list[str], carry: list[str], source_id: str) -> DataFrame:
    """Means of technical replicates, the carried columns, ``;``-joined sorted source ids and the group's size; null keys form groups."""
    aggs = [F.avg(v).alias(f"mean_{v}") for v in values] + [F.min(c).alias(c) for c in carry]
    return df.groupBy(*key).agg(*aggs, F.array_join(F.array_sort(F.collect_list(F.col(source_id).cast("string"))), ";").alias("source_ids"), F.count(F.lit(1)).alias("replicate_n"))


def conflicting_groups(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Groups with more than one value of a column that should be the same (null counts as a value)."""
    return df.groupBy(*key).agg((F.countDistinct(column) + F.max(F.col(column).isNull().cast("int"))).alias("levels")).where("levels > 1")


def repeated_cells(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
