"""Consolidating pairwise matches into groups.

Every record takes the smallest label among itself and its neighbours; labels then jump to their label's label until none
changes, so that chains collapse in a logarithm of their length. What remains are edges between different labels: they are told
in labels, and the next round runs on them alone. Each round at least halves the labels that still have an edge, and every
table is written to the shared folder; the loop ends when no edge joins different labels. The rounds' labels are then
followed from the last one back to the first.

Defined results: null and blank ends, self pairs and repeated pairs add nothing; a group's identifier is its
smallest member; a record without a pair gives no row. Minima are combined before every shuffle; a join has one row a
label on its right, so a hot record or label on its left is split by the engine at run time; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.scratch import Scratch


def _labels(edges: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """id, label of all ends of edges(u, v): the smallest neighbours, followed until no label changes."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("label")), F.struct(F.col("v").alias("id"), F.col("u").alias("label")))).alias("e")).select("e.id", "e.label")
    labels = scratch.write(both.groupBy("id").agg(F.min("label").alias("label")).select("id", F.least("id", "label").alias("label"), F.lit(True).alias("moved")), f"l{k}_0")
    j, moved = 0, 1
    while moved:
        j += 1
        one = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        two = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        # two jumps; a label that is its own label has arrived
        jumped = labels.where("moved").join(one, "label").join(two, "next").select("id", F.col("far").alias("label"), (F.col("far") != F.col("next")).alias("moved"))
        now, moved = scratch.counted(jumped.unionByName(labels.where("not moved")), f"l{k}_{j}", F.col("moved"))
        scratch.drop(f"l{k}_{j - 1}")
        labels = now
    return labels.select("id", "label")


def consolidate(pairs: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """id, group_id for every record of a group of two or more."""
    scratch = scratch or Scratch(pairs.sparkSession, "groups")
    edges, left = scratch.counted(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"`{a}` <> `{b}` and `{a}` <> '' and `{b}` <> ''").distinct(), "e0", F.lit(True))
    rounds: list[DataFrame] = []
    while left:
        k = len(rounds)
        labels = _labels(edges, scratch, k)
        rounds.append(labels)
        as_end = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
        told = edges.join(as_end("u"), "u").join(as_end("v"), "v").where("label_u <> label_v")
        edges, left = scratch.counted(told.select(F.least("label_u", "label_v").alias("u"), F.greatest("label_u", "label_v").alias("v")).distinct(), f"e{k + 1}", F.lit(True))
        scratch.drop(f"e{k}")
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    final = rounds[-1]
    for labels in reversed(rounds[:-1]):
        later = final.select(F.col("id").alias("label"), F.col("label").alias("later"))
        final = labels.join(later, "label", "left").select("id", F.coalesce("later", "label").alias("label"))
    return final.withColumnRenamed("label", "group_id")


def study_versions(trail: DataFrame, records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """record_id, group_id of records that are versions of one study."""
    ends = trail.where(F.lower(F.trim("relation")) == "same_study_version").select(F.trim("source_id").alias("a"), F.trim("target_id").alias("b")).where("a <> b and a <> '' and b <> ''").distinct()
    known = records.select(F.col("record_id").alias("id")).where("id is not null").distinct()
    pairs = ends.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    return consolidate(pairs, "a", "b", scratch).withColumnRenamed("id", "record_id")
