"""Neighbours and running sums in sorted order without one task per group.

A window function sorts a whole group in one task. Here rows are range-partitioned by group and
order, so a hot group spreads over many partitions; what crosses a partition's edge comes from
one summary row per partition (and group), which is as small as the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.scratch import Scratch


def _ranged(df: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    # written, so that the ranges, which are sampled, are the same for the rows and for the edges
    return scratch.write(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id()), name)


def _same(a: str, names: list[str]) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{a}.{n}"))
    return same


def with_previous(df: DataFrame, group: list[str], order: list[str], carry: str, scratch: Scratch, name: str, out: str = "previous") -> DataFrame:
    """Adds ``out``: the ``carry`` of the row before, in the same group by ``order`` (null for the first).

    ``order`` must be a total order within a group; ties are broken by ``carry``.
    """
    by = [*group, *order, *([carry] if carry not in order else [])]
    t = _ranged(df, by, scratch, name)
    keyed = F.struct(*by)
    w = Window.partitionBy("_pid", *group).orderBy(*by)
    tails = t.groupBy("_pid").agg(F.max(keyed).alias("_tail"))
    # one row per partition: a single task orders them
    edges = tails.select("_pid", F.lag("_tail").over(Window.orderBy("_pid")).alias("_edge"))
    return (
        t.withColumn("_first", F.row_number().over(w) == 1)
        .withColumn("_lag", F.lag(carry).over(w))
        .join(F.broadcast(edges), "_pid", "left")
        .withColumn(out, F.when(~F.col("_first"), F.col("_lag")).when(_same("_edge", group), F.col(f"_edge.{carry}")))
        .drop("_pid", "_first", "_lag", "_edge")
    )


def with_running(df: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, str, bool]], scratch: Scratch, name: str) -> DataFrame:
    """Adds running aggregates by ``order`` (a total order within a group; group columns may be null).

    ``values``: new column -> (column, "sum", "max" or "min", whether this row itself counts). A running sum
    starts at 0, a running maximum or minimum of no rows is null.
    """
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    t = _ranged(df, [*group, *order], scratch, name)
    w = Window.partitionBy("_pid", *group).orderBy(*order)
    part = t.groupBy("_pid", *group).agg(*[how[f](c).alias(f"_all_{n}") for n, (c, f, _) in values.items()])
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition and group: what came in earlier partitions
    before = part.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], *[how[f](f"_all_{n}").over(earlier).alias(f"_before_{n}") for n, (_, f, _) in values.items()])
    for n, (c, f, own) in values.items():
        t = t.withColumn(f"_own_{n}", how[f](c).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)))
    same = F.col("_pid") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    j = t.join(before, same)
    for n, (_, f, _) in values.items():
        a, b = F.col(f"_own_{n}"), F.col(f"_before_{n}")
        j = j.withColumn(n, F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if f == "sum" else F.greatest(a, b) if f == "max" else F.least(a, b))
    return j.select(*df.columns, *values)


def with_running_sum(df: DataFrame, group: list[str], order: list[str], value: str, scratch: Scratch, name: str, out: str = "running") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's rows up to this one by ``order`` (a total order)."""
    return with_running(df, group, order, {out: (value, "sum", True)}, scratch, name)
