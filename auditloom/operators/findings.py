"""Audit rules over ledgers: every rule gives rows of (severity, rule, entity_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import filled, norm
from auditloom.operators.ordering import with_running
from auditloom.operators.skew import skew_join
from auditloom.scratch import Scratch


def finding(df: DataFrame, severity: str, rule: str, entity: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.coalesce(entity.cast("string"), F.lit("")).alias("entity_id"), message.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def citation_trail(trail: DataFrame, records: DataFrame, relations: list[str]) -> DataFrame:
    """Self edges, unknown relations, repeated edges and unknown ends of a citation trail."""
    e = trail.select(norm("source_id").alias("s"), norm("target_id").alias("t"), F.lower(norm("relation")).alias("r"))
    name = F.concat_ws("->", "s", "t")
    ids = records.select(F.col("record_id").alias("id")).where("id is not null").distinct()
    ends = e.select(F.explode(F.array("s", "t")).alias("id")).where("id <> ''").distinct()
    blank = e.where("s = '' or t = ''").select(F.concat_ws("->", "s", "t").alias("id"))
    return union([
        finding(e.where("s = t and s <> ''"), "error", "self_edge", name, F.lit("an edge from a record to itself")),
        finding(e.where(~F.col("r").isin(*relations)), "error", "unknown_relation", name, F.concat(F.lit("relation "), F.col("r"))),
        finding(e.groupBy("s", "t", "r").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "warning", "repeated_edge", name, F.concat(F.lit("times "), F.col("n").cast("string"))),
        finding(ends.join(ids, "id", "left_anti"), "error", "unknown_end", F.col("id"), F.lit("no such record")),
        finding(blank, "error", "blank_end", F.col("id"), F.lit("an end is blank")),
    ])


def latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last delivery of each row; of equal times the greatest."""
    return df.where(F.col(key).isNotNull()).groupBy(F.trim(key).alias(key)).agg(F.max(F.struct("loaded_at", *columns)).alias("d")).select(key, *[f"d.{c}" for c in columns])


def claim_lifecycle(claims: DataFrame) -> DataFrame:
    """Links recorded on one side only, active claims that are superseded, retired ones without a reason, self links."""
    c = latest(claims, "claim_id", ["lifecycle_state", "retirement_reason", "supersedes_claim_ids", "superseded_by_claim_ids"])
    down = c.select(F.col("claim_id").alias("parent"), F.explode("supersedes_claim_ids").alias("x")).select("parent", F.trim("x").alias("child")).where("child <> ''").distinct()
    up = c.select(F.col("claim_id").alias("child"), F.explode("superseded_by_claim_ids").alias("x")).select(F.trim("x").alias("parent"), "child").where("parent <> ''").distinct()
    state = F.lower(norm("lifecycle_state"))
    gone = c.where(state.isin("superseded", "retired")).select("claim_id", filled("retirement_reason").alias("why"), state.alias("st"))
    return union([
        finding(down.join(up, ["parent", "child"], "left_anti"), "error", "not_reciprocal", F.col("parent"), F.concat(F.lit("supersedes "), F.col("child"), F.lit(", which doesn't say so"))),
        finding(up.join(down, ["parent", "child"], "left_anti"), "error", "not_reciprocal", F.col("child"), F.concat(F.lit("superseded by "), F.col("parent"), F.lit(", which doesn't say so"))),
        finding(c.where(state.isin("", "active") & (F.size("superseded_by_claim_ids") > 0)), "error", "active_but_superseded", F.col("claim_id"), F.lit("an active claim is superseded")),
        finding(gone.where("why is null"), "warning", "no_reason", F.col("claim_id"), F.concat(F.col("st"), F.lit(" without a reason"))),
        finding(down.where("parent = child"), "error", "self_link", F.col("parent"), F.lit("a claim supersedes itself")),
    ])


def claim_families(claims: DataFrame) -> DataFrame:
    """family_id, members, sections, strengths, scopes and the evidence that all active members share."""
    c = latest(claims, "claim_id", ["claim_family_id", "section", "strength", "source_scope", "lifecycle_state", "evidence_ids"]).where(F.lower(norm("lifecycle_state")).isin("", "active") & filled("claim_family_id").isNotNull())
    c = c.withColumn("family_id", F.trim("claim_family_id"))
    lists = [F.array_join(F.array_sort(F.collect_set(norm(x))), ";").alias(n) for x, n in (("section", "sections"), ("strength", "strengths"), ("source_scope", "scopes"))]
    base = c.groupBy("family_id").agg(F.count(F.lit(1)).alias("members"), *lists)
    # evidence named by as many members as the family has
    used = c.select("family_id", F.explode(F.array_distinct(F.transform("evidence_ids", lambda x: F.trim(x)))).alias("e")).where("e <> ''").groupBy("family_id", "e").agg(F.count(F.lit(1)).alias("k"))
    shared = skew_join(used, base.select("family_id", "members"), ["family_id"]).where("k = members").groupBy("family_id").agg(F.count(F.lit(1)).alias("shared_evidence"))
    return base.join(shared, "family_id", "left").select("family_id", "members", "sections", "strengths", "scopes", F.coalesce("shared_evidence", F.lit(0)).cast("long").alias("shared_evidence"))


def evidence_state(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, evidence, verified, sources, state: gap, single_source or consistent, by eligible (verified or partial) evidence."""
    c = latest(claims, "claim_id", ["evidence_ids"])
    e = evidence.where("evidence_id is not null").groupBy(F.trim("evidence_id").alias("e")).agg(F.max(F.struct("loaded_at", "verification", "source_id")).alias("d")).select("e", F.lower(norm("d.verification")).alias("v"), norm("d.source_id").alias("s"))
    links = c.select("claim_id", F.explode_outer(F.array_distinct(F.transform("evidence_ids", lambda x: F.trim(x)))).alias("e"))
    j = skew_join(links, e, ["e"], "left")
    ok = F.col("v").isin("verified", "partial")
    a = j.groupBy("claim_id").agg(F.count(F.when(ok, 1)).alias("evidence"), F.count(F.when(F.col("v") == "verified", 1)).alias("verified"), F.countDistinct(F.when(ok & (F.col("s") != ""), F.col("s"))).alias("sources"))
    return a.withColumn("state", F.when(F.col("evidence") == 0, "gap").when(F.col("sources") <= 1, "single_source").otherwise("consistent"))


def reconcile_events(events: DataFrame, entity: str, stage: Column, decision: str, order: list[str]) -> DataFrame:
    """entity, stage, decision (the last of the highest stage), events, decisions (distinct ones there), conflict.

    Plain aggregates: the highest stage's rows are found with the maximum itself, so no window sorts an entity.
    """
    e = events.withColumn("_stage", stage)
    top = e.groupBy(entity).agg(F.max("_stage").alias("_top"), F.count(F.lit(1)).alias("events"))
    at = skew_join(e, top, [entity]).where(F.col("_stage") == F.col("_top"))
    return at.groupBy(entity).agg(F.max("_stage").alias("stage"), F.max_by(decision, F.struct(*order)).alias("decision"), F.max("events").alias("events"), F.countDistinct(decision).alias("decisions")).withColumn("conflict", F.col("decisions") > 1)


def retries(attempts: DataFrame, run: list[str], started: str, finished: Column, ok: Column, ident: str, scratch: Scratch) -> DataFrame:
    """run, id, after_success, overlap: attempts that follow a success of their run, or begin before an earlier one ended."""
    a = attempts.select(*run, ident, F.col(started).alias("_s"), finished.alias("_f"), ok.alias("_ok"))
    r = with_running(a, run, ["_s", ident], {"_done": ("_ok", "max", False), "_until": ("_f", "max", False)}, scratch, "attempts")
    return r.select(*run, ident, F.coalesce("_done", F.lit(False)).alias("after_success"), F.coalesce(F.col("_s") < F.col("_until"), F.lit(False)).alias("overlap"))


def full_compare(expected: DataFrame, actual: DataFrame, key: list[str], fields: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """key, field, kind (missing, unexpected, differs) of a full outer comparison with tolerance; null equals null."""
    e = expected.select(*key, F.struct(*fields).alias("e"))
    a = actual.select(*key, F.struct(*fields).alias("a"))
    j = e.join(a, key, "full_outer")

    def differs(f: str, kind: str) -> Column:
        x, y = F.col(f"e.{f}"), F.col(f"a.{f}")
        if kind in ("double", "float"):
            return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > F.greatest(F.lit(rtol) * F.greatest(F.abs(x), F.abs(y)), F.lit(atol)), F.lit(False))
        return ~x.eqNullSafe(y)

    kinds = dict(expected.dtypes)
    checks = F.filter(F.array(*[F.when(differs(f, kinds[f]), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    out = F.when(F.col("a").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit("missing").alias("kind")))).when(F.col("e").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit("unexpected").alias("kind")))).otherwise(F.transform(checks, lambda f: F.struct(f.alias("field"), F.lit("differs").alias("kind"))))
    return j.select(*key, F.explode(out).alias("f")).select(*key, "f.*")


def tolerance_state(reported: Column, observed: Column, low: Column, high: Column) -> Column:
    """reproduced within the reported variation, else within twice its width partly, else not; unknown without values."""
    width = high - low
    return F.when(reported.isNull() | observed.isNull(), "not_comparable").when((observed >= low) & (observed <= high), "reproduced").when((observed >= low - width / 2) & (observed <= high + width / 2), "partially_reproduced").otherwise("not_reproduced")


def columns_contract(df: DataFrame, required: list[str]) -> DataFrame:
    """column, state (missing, extra) of a table against its contract."""
    spark = df.sparkSession
    rows = [(c, "missing") for c in required if c not in df.columns] + [(c, "extra") for c in df.columns if c not in required]
    return spark.createDataFrame(rows, "column string, state string")


def migrate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """The table with blank columns where the contract has more; content is never inferred."""
    return reduce(lambda d, c: d.withColumn(c, F.lit("")), [c for c in required if c not in df.columns], df)


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """only_left, only_right: how many rows of either side the other lacks, each counted (null equals null). One aggregate in place of two differences."""
    tagged = left.select(*columns, F.lit(1).alias("_w")).unionByName(right.select(*columns, F.lit(-1).alias("_w")))
    n = tagged.groupBy(*columns).agg(F.sum("_w").alias("_d"))
    return n.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).cast("long").alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("long").alias("only_right"))
