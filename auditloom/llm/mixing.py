"""Mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by a hash; each draw's virtual finish time is the source's running
token count, over as many passes as the source may be repeated, divided by its weight. All draws of a mix
are sorted by finish time over the cluster and cut where the running total reaches the mix's budget.
A source that runs out leaves its room to the others; the actual shares tell by how much.

Defined results: a source's name is trimmed and in lower case; null, zero and negative shares draw nothing, nor do
texts without tokens; ``max_repeats`` is the number of times a document is drawn at most (null is 1); repeated
target rows count once; the last draw never exceeds the budget; ties of finish time are broken by source and
document. Running sums are by range partitions, so a source with a third of all documents is no single task. The
targets (a fixed table) are read by the driver, up to ``MAX_TARGETS`` rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import norm
from auditloom.llm.tokens import VOCABULARY, count_tokens
from auditloom.operators.ordering import with_running_sum
from auditloom.scratch import Scratch

MAX_TARGETS = 100_000


def latest_needed(parts: list[tuple[float, float, float]], budget: float) -> float:
    """A finish time by which the draws surely reach the budget, for parts (weight, supply, largest document).

    At time t a part has given at least min(t * weight, supply) less one document.
    """
    reach = lambda t: sum(min(t * w, s) - (d if t * w < s else 0) for w, s, d in parts)
    if reach(float("inf")) < budget:
        return float("inf")
    low, high = 0.0, 1.0
    while reach(high) < budget:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if reach(mid) >= budget else (mid, high)
    return high


def sized_documents(documents: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document."""
    return count_tokens(documents.select("doc_id", norm(F.lower("source")).alias("source"), "text"), ["doc_id", "source"], "text", vocabulary_path)


def draw(documents: DataFrame, targets: DataFrame, seed: int = 42, vocabulary_path: str = VOCABULARY, scratch: Scratch | None = None) -> DataFrame:
    """mix_id, doc_id, source, repeat (from 1), tokens of every drawn document."""
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    rows = _clean(targets).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError("mix targets are meant to be a small table")
    sized = scratch.write(sized_documents(documents, vocabulary_path).where("tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), "sized")
    # as many names as targets at most
    named = spark.createDataFrame([(x,) for x in sorted({r.source for r in rows})], "source string")
    totals = {r.source: r for r in sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.max("tokens").alias("largest")).join(F.broadcast(named), "source", "left_semi").collect()}
    corpus = sized.agg(F.sum("tokens").alias("n")).collect()[0].n or 0
    mixes = defaultdict(list)
    for r in rows:
        mixes[r.mix_id].append(r)
    plan = []
    for mix, parts in mixes.items():
        whole = sum(r.target_share for r in parts)
        budget = max(r.size_ratio for r in parts) * corpus
        have = [(r, totals[r.source]) for r in parts if r.source in totals]
        end = latest_needed([(r.target_share / whole, t.supply * r.max_repeats, t.largest) for r, t in have], budget)
        plan += [(mix, r.source, r.target_share / whole, r.max_repeats, float(t.supply), float(budget), end) for r, t in have]
    planned = spark.createDataFrame(plan, "mix_id string, source string, weight double, repeats int, supply double, budget double, latest double")
    queued = with_running_sum(sized, ["source"], ["h", "doc_id"], "tokens", scratch, "queued", "served")
    # only passes whose finish time may still be needed
    passes = queued.join(F.broadcast(planned), "source").withColumn("most", F.least(F.col("repeats").cast("double"), F.floor((F.col("latest") * F.col("weight") - F.col("served")) / F.col("supply")) + 1.0).cast("int")).where("most > 0")
    draws = passes.select("mix_id", "doc_id", "source", "tokens", "budget", "weight", "supply", "served", F.explode(F.sequence(F.lit(1), "most")).alias("repeat"))
    timed = draws.select("mix_id", "doc_id", "source", "repeat", "tokens", "budget", (((F.col("repeat") - 1) * F.col("supply") + F.col("served")) / F.col("weight")).alias("finish"))
    taken = with_running_sum(timed, ["mix_id"], ["finish", "source", "doc_id", "repeat"], "tokens", scratch, "timed", "total")
    return taken.where(F.col("total") <= F.col("budget")).select("mix_id", "doc_id", "source", F.col("repeat").cast("long").alias("repeat"), "tokens")


def _clean(targets: DataFrame) -> DataFrame:
    """One row a mix and source with a positive share."""
    t = targets.where("mix_id is not null and target_share > 0 and not isnan(target_share)").select("mix_id", norm(F.lower("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("size_ratio", F.lit(1.0)).alias("size_ratio"))
    return t.where("source <> '' and max_repeats > 0").groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share, actual_share, documents, draws, tokens, most_repeats for every target with a share."""
    t = _clean(targets)
    target = t.join(t.groupBy("mix_id").agg(F.sum("target_share").alias("whole")), "mix_id").select("mix_id", "source", (F.col("target_share") / F.col("whole")).alias("target_share"))
    got = drawn.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("draws"), F.count(F.when(F.col("repeat") == 1, 1)).alias("documents"), F.max("repeat").alias("most_repeats"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return target.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), zero("documents"), zero("draws"), zero("tokens"), zero("most_repeats"))
