"""Exact quantiles and midranks by running counts over sorted distinct values.

The built-in exact percentile keeps all distinct values of a group in one buffer; here the values
are counted, range-partitioned and summed up in order, so no task holds a group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.dist import beta_inc
from auditloom.operators.ordering import with_running_sum
from auditloom.scratch import Scratch


def quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], scratch: Scratch | None = None, name: str = "quantiles") -> DataFrame:
    """One row a group with a column for each of ``probs``, by linear interpolation between neighbours (null and NaN values don't count)."""
    scratch = scratch or Scratch(df.sparkSession, "quantiles")
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = scratch.write(with_running_sum(clean, group, ["_v"], "_c", scratch, f"{name}_sorted", "_upto"), name)
    total = run.groupBy(*group).agg(F.sum("_c").alias("_n"))
    at = run.join(total, group) if group else run.withColumn("_n", total.scalar())
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1  # 0-based positions that hold the value
    out = []
    for c, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(p)
        low, high = F.floor(pos), F.ceil(pos)
        lo = F.max(F.when((first <= low) & (low <= last), F.col("_v")))
        hi = F.max(F.when((first <= high) & (high <= last), F.col("_v")))
        out.append((lo + (hi - lo) * F.max(pos - low)).alias(c))
    return at.groupBy(*group).agg(*out)


def value_counts_with_rank(df: DataFrame, value: str, parts: list[str], scratch: Scratch, name: str = "ranks") -> DataFrame:
    """Distinct values with the 0/1 columns ``parts`` summed, ``_t`` (ties), ``_upto`` and the midrank."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_t"), *[F.sum(p).alias(p) for p in parts])
    run = with_running_sum(counted, [], ["_v"], "_t", scratch, name, "_upto")
    return run.withColumn("midrank", F.col("_upto") - (F.col("_t") - 1) / 2.0)


def median_positions(n: int, level: float) -> tuple[int, int]:
    """Ranks (from 1) of the percentile bootstrap's limits for the median of n values, in the limit of many resamples.

    A resample's m-th smallest value is at most the k-th of the sample with the chance that m or more of n draws fall
    among the first k, a binomial tail; so no resampling is needed. Of an even number the lower middle
    gives the lower limit and the upper middle the upper one.
    """
    if n < 1:
        return 0, 0

    def least(m: int, p: float) -> int:
        low, high = 1, n
        while low < high:
            k = (low + high) // 2
            low, high = (low, k) if beta_inc(m, n - m + 1, k / n) >= p else (k + 1, high)
        return low

    a = (1 - level) / 2
    return least((n + 1) // 2, a), least(n // 2 + 1, 1 - a)


@F.pandas_udf(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
def _median_positions(n: pd.Series, level: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([median_positions(int(x), float(v)) if not math.isnan(x) else (0, 0) for x, v in zip(n, level)], columns=["low", "high"])


def median_intervals(df: DataFrame, group: list[str], value: str, level: float = 0.95, scratch: Scratch | None = None, name: str = "medians") -> DataFrame:
    """group, n, ci_low, ci_high: bootstrap limits of each group's median, as values of the sample found by running counts."""
    scratch = scratch or Scratch(df.sparkSession, "medians")
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = scratch.write(with_running_sum(clean, group, ["_v"], "_c", scratch, f"{name}_sorted", "_upto"), name)
    total = run.groupBy(*group).agg(F.sum("_c").alias("n")).withColumn("_p", _median_positions("n", F.lit(level)))
    at = run.join(total, group) if group else run.withColumn("_t", total.select(F.struct("*")).scalar()).select("*", "_t.*").drop("_t")
    holds = lambda k: (F.col("_upto") - F.col("_c") < k) & (k <= F.col("_upto"))
    return at.groupBy(*group).agg(F.max("n").alias("n"), F.max(F.when(holds(F.col("_p.low")), F.col("_v"))).alias("ci_low"), F.max(F.when(holds(F.col("_p.high")), F.col("_v"))).alias("ci_high"))
