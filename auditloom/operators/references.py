"""References to records that do not exist, are deleted or come later.

One exact join of the references with the parents' state, nothing on the driver: filters of the parents' keys spare it
only the rows of missing targets, and the driver had to hold each filter once for every place that asks it.

Defined results: blank and null references are none; a reference counts once per referring id, target, status
and month; a parent is deleted when all its rows are; a null ``loaded_at`` of the referring row gives period ''
and is never late; a hot target is split by the engine at run time; an empty parent table makes all missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import filled

#: Bits of one filter, and how many filters the keys may be divided among by their hash (64 MB in all).
MAX_BITS, MAX_FILTERS = 64 * 1024 * 1024, 8
BITS_A_KEY = 12


def bloom_filters(df: DataFrame, key: str, expected: int) -> list[Column]:
    """Filters of ``key``'s hashes as fields of one scalar subquery, built by partial aggregation on the executors.

    One filter serves 5.6 million keys at ``BITS_A_KEY`` bits each (0.3 % false positives), all ``MAX_FILTERS`` 45 million; with more
    keys more references pass and are verified by the join: 5 % at 86 million, 45 % at 270 million.
    """
    parts = max(1, min(MAX_FILTERS, -(-expected * BITS_A_KEY // MAX_BITS)))
    each = max(1, -(-expected // parts))
    bits = max(64, min(MAX_BITS, each * BITS_A_KEY))
    jvm = df.sparkSession.sparkContext._jvm
    util = getattr(jvm.org.apache.spark.sql.classic, "ExpressionUtils")
    lit = lambda n: util.expression(F.lit(n).cast("long")._jc)
    h = F.xxhash64(key)

    def agg(i: int) -> Column:
        mine = h if parts == 1 else F.when(F.pmod(h, F.lit(parts)) == i, h)
        a = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(util.expression(mine._jc), lit(each), lit(bits))
        return Column(util.column(a.toAggregateExpression()))

    if parts == 1:
        return [df.agg(agg(0).alias("f")).scalar()]
    one = df.agg(*[agg(i).alias(f"f{i}") for i in range(parts)]).select(F.struct(*[f"f{i}" for i in range(parts)]).alias("f")).scalar()
    return [one.getField(f"f{i}") for i in range(parts)]


def might_contain(blooms: list[Column], key: Column) -> Column:
    """False only where the filters prove that ``key`` isn't in them."""
    jvm = SparkSession.active().sparkContext._jvm
    util = getattr(jvm.org.apache.spark.sql.classic, "ExpressionUtils")
    h = F.xxhash64(key)
    asked = [Column(util.column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(util.expression(b._jc), util.expression(h._jc)))) for b in blooms]
    out = asked[0]
    for i, a in enumerate(asked[1:], 1):
        out = F.when(F.pmod(h, F.lit(len(asked))) == i, a).otherwise(out)
    # a filter without keys is null
    return F.coalesce(out, F.lit(False))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs(ref_field, from_id, target_id, at) against parents(ref_field, target_id, gone, first_at)."""
    state = parents.groupBy("ref_field", "target_id").agg(F.min("gone").alias("gone"), F.min("first_at").alias("first_at"))
    # one row a key on the right: a target that many refer to is split by the engine at run time, without a count beforehand
    joined = refs.join(state, ["ref_field", "target_id"], "left")
    status = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_at") > F.col("at"), "late")
    return joined.withColumn("status", status).where(F.col("status").isNotNull()).select("ref_field", "from_id", "target_id", "status", "at")


def ledger_references(claims: DataFrame, trail: DataFrame, evidence: DataFrame, sources: DataFrame, records: DataFrame) -> DataFrame:
    """ref_field, from_id, target_id, status, period of the ledgers' orphan references."""
    ref = lambda df, field, source, target: df.select(F.lit(field).alias("ref_field"), source.alias("from_id"), filled(target).alias("target_id"), F.col("loaded_at").alias("at")).where(F.col("target_id").isNotNull())
    cited = claims.select("claim_id", "loaded_at", F.explode("evidence_ids").alias("t"))
    shown = claims.select("claim_id", "loaded_at", F.explode("object_refs.source_id").alias("t"))
    who = F.coalesce(F.col("claim_id"), F.lit(""))
    refs = ref(cited, "claims.evidence_ids", who, F.col("t")).unionByName(ref(shown, "claims.object_refs.source_id", who, F.col("t"))).unionByName(ref(trail, "citation_trail.target_id", F.coalesce(F.trim("source_id"), F.lit("")), F.col("target_id")))
    par = lambda df, field, key: df.where(F.col(key).isNotNull()).select(F.lit(field).alias("ref_field"), F.col(key).alias("target_id"), F.col("deleted_at").isNotNull().alias("gone"), F.col("loaded_at").alias("first_at"))
    parents = par(evidence, "claims.evidence_ids", "evidence_id").unionByName(par(sources, "claims.object_refs.source_id", "source_id")).unionByName(par(records, "citation_trail.target_id", "record_id"))
    out = orphans(refs, parents)
    return out.select("ref_field", "from_id", "target_id", "status", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("period")).distinct()


def by_table_and_period(found: DataFrame) -> DataFrame:
    """Orphan references per referring field, status and month."""
    return found.groupBy("ref_field", "status", "period").agg(F.count(F.lit(1)).alias("references"), F.countDistinct("target_id").alias("targets"))
