"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def heavy_bound(df: DataFrame) -> int:
    """How many heavy keys are told apart; a key below 1/bound of the rows fits an ordinary task."""
    return max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, keys: list[str]) -> list[tuple]:
    """Keys with more than 1/bound of all rows.

    There are fewer than ``bound`` of them whatever the data, as their shares add up to one at
    most, so the list may be held by the driver. Counts are combined before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg((F.sum("_n") / F.lit(heavy_bound(df))).alias("_t")).scalar()
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("_n") > total).collect()]


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", heavy: list[tuple] | None = None) -> DataFrame:
    """Inner or left join of ``left`` with ``right``, which has one row per key.

    Rows of heavy keys meet a broadcast of their keys' rows of ``right`` (fewer than
    ``heavy_bound`` rows) and are not shuffled; the others are joined as usual.
    Null keys match nothing and stay where they are. Both sides share only ``keys``.
    """
    if heavy is None:
        heavy = heavy_keys(left.where(" and ".join(f"`{k}` is not null" for k in keys)), keys)
    if not heavy:
        return left.join(right, keys, how)
    spark = left.sparkSession
    fields = {f.name: f.dataType for f in left.schema.fields}
    hot = spark.createDataFrame([(*h, True) for h in heavy], T.StructType([T.StructField(k, fields[k]) for k in keys] + [T.StructField("_hot", T.BooleanType())]))
    marked = left.join(F.broadcast(hot), keys, "left")
    few = right.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
    a = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
    b = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(few), keys, how)
    return a.unionByName(b)
