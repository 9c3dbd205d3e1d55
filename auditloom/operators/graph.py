"""The evidence graph: records, claims, evidence and sources as nodes, their references as typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import norm


def nodes(records: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """type, id: every id of a ledger once, deleted or not; blank ids are no nodes."""
    of = lambda df, c, t: df.select(F.lit(t).alias("type"), norm(c).alias("id")).where("id <> ''")
    return reduce(lambda a, b: a.unionByName(b), [of(records, "record_id", "record"), of(claims, "claim_id", "claim"), of(evidence, "evidence_id", "evidence"), of(sources, "source_id", "source")]).distinct()


def edges(trail: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """type, source, target: citations by their relation, claims' evidence, evidence's sources; an edge with a blank end is none, repeated ones are one."""
    cites = trail.select(F.lower(norm("relation")).alias("type"), norm("source_id").alias("source"), norm("target_id").alias("target"))
    uses = claims.select(F.lit("claim_evidence").alias("type"), norm("claim_id").alias("source"), F.explode("evidence_ids").alias("x")).select("type", "source", norm("x").alias("target"))
    told = evidence.select(F.lit("evidence_source").alias("type"), norm("evidence_id").alias("source"), norm("source_id").alias("target"))
    return cites.unionByName(uses).unionByName(told).where("source <> '' and target <> ''").distinct()


def dangling(graph_nodes: DataFrame, graph_edges: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    """type, source, target, missing (source or target) of edges whose end is no node of the type it should have: types(edge type -> source type, target type)."""
    parts = []
    for t, ends in types.items():
        mine = graph_edges.where(F.col("type") == t)
        for side, kind in zip(("source", "target"), ends):
            parts.append(mine.join(graph_nodes.where(F.col("type") == kind).select(F.col("id").alias(side)), side, "left_anti").select("type", "source", "target", F.lit(side).alias("missing")))
    return reduce(lambda a, b: a.unionByName(b), parts)
