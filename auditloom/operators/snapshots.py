"""What changed between full snapshots, by content-defined chunks.

A snapshot's rows are sorted by key and cut into chunks where a hash of the key says so, which does
not depend on other rows: equal stretches of two snapshots are cut alike. Chunks with the same
digest on both sides are discarded; only the rows of the others are joined by key.

Defined results: a snapshot delivered more than once counts as its latest delivery (at equal times by taken_at, then by digest);
the first snapshot of a series has nothing to report; null is a value; an absent or null section is empty; a
payload that can't be read is an empty snapshot; exact repeats count once. Rows are range-partitioned, so a
huge snapshot or a series with a third of all rows spreads over many tasks; a cut at a
partition's edge only makes a chunk compare by rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ordering import with_previous
from auditloom.operators.references import bloom_filters, might_contain
from auditloom.operators.skew import skew_join
from auditloom.scratch import Scratch

#: Rows of a chunk on average.
CHUNK_ROWS = 8
_CHUNK = "series string, snapshot string, digest binary, rows array<struct<section:string,entry:string,value:string>>"


def cut(batches: Iterator[pd.DataFrame], chunk_rows: int = CHUNK_ROWS) -> Iterator[pd.DataFrame]:
    """Sorted rows (series, snapshot, section, entry, value) to chunks; a row equal to the one before it, as when a delivery is there twice, counts once."""
    names = ["series", "snapshot", "digest", "rows"]
    at, rows = None, []

    def close() -> list[tuple]:
        if not rows:
            return []
        h = hashlib.blake2b(digest_size=16)
        for s, e, v in rows:
            for part in (s, e, v):
                raw = b"" if part is None else part.encode("utf-8", "surrogatepass")
                h.update(b"%d:" % (-1 if part is None else len(raw)) + raw)
        return [(*at, h.digest(), [{"section": s, "entry": e, "value": v} for s, e, v in rows])]

    for b in batches:
        out: list[tuple] = []
        for series, snap, s, e, v in b.itertuples(index=False, name=None):
            if at == (series, snap) and rows[-1] == (s, e, v):
                continue
            edge = xxhash.xxh64_intdigest(f"{s}\u0001{e}".encode("utf-8", "surrogatepass")) % chunk_rows == 0
            if at != (series, snap) or edge:
                out += close()
                at, rows = (series, snap), []
            rows.append((s, e, v))
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(close(), columns=names)


def snapshot_changes(entries: DataFrame, snapshots: DataFrame, scratch: Scratch, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """series, snapshot, section, entry, change.

    entries(series, snapshot, section, entry, value); snapshots(series, snapshot, taken_at) in order of taken_at.
    """
    order = with_previous(snapshots, ["series"], ["taken_at", "snapshot"], "snapshot", scratch, "order").select("series", "snapshot", "previous").where("previous is not null")
    order = scratch.write(order, "pairs")
    roles = order.select("series", F.explode(F.array(F.struct(F.col("snapshot").alias("s"), F.lit(True).alias("new"), F.col("snapshot").alias("pair")), F.struct(F.col("previous").alias("s"), F.lit(False).alias("new"), F.col("snapshot").alias("pair")))).alias("r"))
    roles = roles.groupBy("series", F.col("r.s").alias("snapshot")).agg(F.max(F.when(F.col("r.new"), F.col("r.pair"))).alias("as_new"), F.max(F.when(~F.col("r.new"), F.col("r.pair"))).alias("as_old"))
    by = ["series", "snapshot", "section", "entry"]
    chunks = scratch.write(entries.select(*by, "value").repartitionByRange(*by).sortWithinPartitions(*by, "value").mapInPandas(lambda b: cut(b, chunk_rows), _CHUNK), "chunks")
    # every chunk serves as its snapshot's and as the next one's earlier state
    both = F.explode(F.array(F.struct(F.lit(True).alias("new"), F.col("as_new").alias("pair")), F.struct(F.lit(False).alias("new"), F.col("as_old").alias("pair"))))
    sided = skew_join(chunks.select("series", "snapshot", "digest"), roles, ["series", "snapshot"]).select("series", "snapshot", "digest", both.alias("r")).where("r.pair is not null").select("series", "snapshot", "digest", "r.*")
    alone = sided.groupBy("series", "pair", "digest").agg(F.min("new").alias("a"), F.max("new").alias("new"), F.min("snapshot").alias("snapshot")).where("a = new")
    need = scratch.write(alone.select("series", "snapshot", "digest", "pair", "new"), "need")
    # a filter of the needed chunks keeps the matched ones from being shuffled; the join is exact
    key = ["series", "snapshot", "digest"]
    hashed = F.xxhash64(*key)
    n = need.count()
    wanted = chunks.where(might_contain(bloom_filters(need.select(hashed.alias("k")), "k", n), hashed)) if n else chunks.limit(0)
    rows = wanted.join(need, key).select("series", "pair", "new", F.explode("rows").alias("e"))
    side = lambda n: F.max(F.when(F.col("new") == n, F.struct("e.value")))
    both = rows.groupBy("series", F.col("pair").alias("snapshot"), "e.section", "e.entry").agg(side(True).alias("n"), side(False).alias("o"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("n.value").eqNullSafe(F.col("o.value")), "changed")
    return both.select("series", "snapshot", "section", "entry", change.alias("change")).where("change is not null")


_PAYLOAD = "state_id string, files map<string,string>, source_files map<string,struct<sha256:string>>, records map<string,map<string,string>>"


def workspace_entries(states: DataFrame) -> DataFrame:
    """series, snapshot, section, entry, value of every state's payload."""
    v = states.select("series", "snapshot", F.from_json("payload", _PAYLOAD).alias("v"), F.array_contains(F.json_object_keys("payload"), "state_id").alias("has"))
    item = lambda s, e, x: F.struct(s.alias("section"), e.alias("entry"), F.lower(x).alias("value"))
    kind = "array<struct<section:string,entry:string,value:string>>"
    none = F.from_json(F.lit("[]"), kind)
    of = lambda c, f: F.coalesce(F.transform(F.map_entries(c), f), none)
    state = F.when(F.col("has"), F.array(item(F.lit("state"), F.lit("state_id"), F.col("v.state_id")))).otherwise(none)
    files = of("v.files", lambda e: item(F.lit("files"), e["key"], e["value"]))
    sources = of("v.source_files", lambda e: item(F.lit("source_files"), e["key"], e["value"]["sha256"]))
    records = F.coalesce(F.flatten(F.transform(F.map_entries(F.map_filter("v.records", lambda k, m: m.isNotNull())), lambda g: F.transform(F.map_entries(g["value"]), lambda e: item(F.concat(F.lit("records."), g["key"]), e["key"], e["value"])))), none)
    return v.select("series", "snapshot", F.explode(F.concat(state, files, sources, records)).alias("e")).select("series", "snapshot", "e.section", "e.entry", "e.value")


def workspace_changes(state: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """project_id, snapshot_id, section, entry, change from each snapshot of a project to the next."""
    scratch = scratch or Scratch(state.sparkSession, "snapshots")
    all_ = state.where("snapshot_id is not null and project_id is not null").select(F.col("project_id").alias("series"), F.col("snapshot_id").alias("snapshot"), "arrived_at", "taken_at", "payload").withColumn("_d", F.xxhash64("payload"))
    # deliveries are compared by time and digest; payloads are shuffled only where a snapshot came more than once
    slim = all_.groupBy("series", "snapshot").agg(F.max(F.struct("arrived_at", "taken_at", "_d")).alias("d"), F.count(F.lit(1)).alias("n"))
    slim = scratch.write(slim.select("series", "snapshot", "d.*", "n"), "snapshots")
    again = slim.where("n > 1")
    n = again.count()
    last = all_
    if n:
        key = F.xxhash64("series", "snapshot")
        more = might_contain(bloom_filters(again.select(key.alias("k")), "k", n), key)
        held = slim.select("series", "snapshot", "arrived_at", "taken_at", "_d")
        same = (all_["series"] == held["series"]) & (all_["snapshot"] == held["snapshot"]) & all_["arrived_at"].eqNullSafe(held["arrived_at"]) & all_["taken_at"].eqNullSafe(held["taken_at"]) & all_["_d"].eqNullSafe(held["_d"])
        last = all_.where(~more).unionByName(all_.where(more).join(held, same, "left_semi"))
    last = last.select("series", "snapshot", "payload")
    out = snapshot_changes(workspace_entries(last), slim.select("series", "snapshot", "taken_at"), scratch)
    return out.withColumnRenamed("series", "project_id").withColumnRenamed("snapshot", "snapshot_id")
