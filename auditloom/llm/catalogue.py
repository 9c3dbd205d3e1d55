"""Queries of the training-data problems, each over its whole tables, and SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import groups, mixing, pii, tokens
from auditloom.plans.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.study_versions(table(spark, d, "citation_trail"), table(spark, d, "records"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p9_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_draws(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


QUERIES = {"p2_found": p2_found, "p8_ids": p8_ids, "p9_draws": p9_draws, "p9_shares": p9_shares, "p10_found": p10_found, "p10_redacted": p10_redacted}

SQL = {
    "p2_found": """WITH RECURSIVE r AS (SELECT DISTINCT record_id AS id FROM records),
      e AS (SELECT DISTINCT trim(source_id) AS a, trim(target_id) AS b FROM citation_trail WHERE lower(trim(relation)) = 'same_study_version'),
      v AS (SELECT a, b FROM e WHERE a <> b AND a IN (SELECT id FROM r) AND b IN (SELECT id FROM r)),
      u AS (SELECT a, b FROM v UNION SELECT b, a FROM v),
      reach AS (SELECT a AS id, b AS other FROM u UNION SELECT reach.id, u.b FROM reach JOIN u ON reach.other = u.a)
      SELECT id AS record_id, least(id, min(other)) AS group_id FROM reach GROUP BY id""",
}
