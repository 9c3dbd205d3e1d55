"""Hashes, states and manifests: canonical objects, directory digests, state identifiers, freeze and verify."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_bytes(v: object) -> bytes:
    """Sorted keys, no blanks, UTF-8."""
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


@F.pandas_udf(T.StringType())
def canonical_hash(s: pd.Series) -> pd.Series:
    """sha256 of a JSON text's canonical form; null for text that isn't JSON."""
    def one(t: str | None) -> str | None:
        try:
            return hashlib.sha256(canonical_bytes(json.loads(t))).hexdigest() if t else None
        except ValueError:
            return None

    return s.map(one)


def stable_seed(base: Column, label: Column) -> Column:
    """The first four bytes of sha256("base::label") as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("::", base.cast("string"), label), 256), 1, 8), 16, 10).cast("long")


def directory_digest(files: DataFrame, group: list[str], name: str, digest: str) -> DataFrame:
    """One hash a group over its sorted names and hashes, one file a line.

    The listing of a group is one row; it has a line a file, so group by directory, not by corpus.
    """
    lines = F.array_sort(F.collect_list(F.concat_ws("\u0000", name, digest)))
    return files.groupBy(*group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def record_state(records: DataFrame, ledger: str, key: str, columns: list[str]) -> DataFrame:
    """ledger, id, hash of each record's named columns (nulls kept)."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return records.where(F.col(key).isNotNull()).select(F.lit(ledger).alias("ledger"), F.trim(key).alias("id"), F.sha2(body, 256).alias("hash")).distinct()


def state_id(state: DataFrame) -> DataFrame:
    """One order-free identifier a ledger: count and two folded hashes of all rows, so no list of them is built."""
    h = F.xxhash64("id", "hash")
    g = F.xxhash64(F.lit("second"), "hash", "id")
    return state.groupBy("ledger").agg(F.count(F.lit(1)).alias("records"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"), F.bit_xor(g).cast("string")), 256).alias("state_id"))


def diff_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """ledger, id, change (added, removed, changed) between two record states."""
    j = old.withColumnRenamed("hash", "o").join(new.withColumnRenamed("hash", "n"), ["ledger", "id"], "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return j.select("ledger", "id", change.alias("change")).where("change is not null")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem (missing, changed, size, unlisted, unsafe) of files against a manifest (path, sha256, length)."""
    m = manifest.select("path", F.lower("sha256").alias("ms"), F.col("length").alias("ml"))
    f = files.select("path", F.lower("sha256").alias("fs"), F.col("length").alias("fl"))
    j = m.join(f, "path", "full_outer")
    unsafe = F.col("path").rlike(r"(^/)|((^|/)\.\.(/|$))")
    problem = F.when(unsafe, "unsafe").when(F.col("fs").isNull(), "missing").when(F.col("ms").isNull(), "unlisted").when(F.col("ms") != F.col("fs"), "changed").when(F.col("ml") != F.col("fl"), "size")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def uncovered_changes(changes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Changed ids that no verified revision names: changes(ledger, id, ...) against revisions(status, affected_ids)."""
    covered = revisions.where(F.lower(F.trim("status")) == "verified").select(F.explode("affected_ids").alias("id")).select(F.trim("id").alias("id")).distinct()
    return changes.join(covered, "id", "left_anti")


def affected_claims(changed_sources: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, how (direct: it uses changed evidence; family: it shares a family with such a claim), over semi joins."""
    ev = evidence.select(F.trim("evidence_id").alias("e"), F.trim("source_id").alias("source_id")).join(changed_sources.select("source_id").distinct(), "source_id", "left_semi").select("e").distinct()
    uses = claims.select(F.trim("claim_id").alias("claim_id"), F.explode("evidence_ids").alias("x")).select("claim_id", F.trim("x").alias("e"))
    direct = uses.join(ev, "e", "left_semi").select("claim_id").distinct()
    fam = claims.where("claim_family_id is not null and trim(claim_family_id) <> ''").select(F.trim("claim_id").alias("claim_id"), F.trim("claim_family_id").alias("f")).distinct()
    hit = fam.join(direct, "claim_id", "left_semi").select("f").distinct()
    family = fam.join(hit, "f", "left_semi").select("claim_id").distinct().join(direct, "claim_id", "left_anti")
    return direct.withColumn("how", F.lit("direct")).unionByName(family.withColumn("how", F.lit("family")))
