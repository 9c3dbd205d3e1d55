"""Record linkage: keys, exact and fuzzy matching, merged records, term vectors and threshold clusters."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import ledger as L
from auditloom.functions.text import filled, norm
from auditloom.operators.components import connected_components
from auditloom.operators.ordering import with_running
from auditloom.operators.similar import candidates
from auditloom.operators.skew import skew_join
from auditloom.scratch import Scratch


def exact_key() -> Column:
    """One key a record: doi, else pmid, pmcid, arxiv id, else the title; null when there is nothing."""
    some = lambda p, c: F.when(c != "", F.concat(F.lit(p), c))
    return F.coalesce(some("doi:", L.norm_doi(F.col("doi"))), some("pmid:", L.norm_id(F.col("pmid"))), some("pmcid:", L.norm_id(F.col("pmcid"))), some("arxiv:", L.norm_id(F.col("arxiv_id"))), some("title:", L.norm_title_ascii(F.col("title"))))


def exact_groups(records: DataFrame) -> DataFrame:
    """record_id, match_key, group_id (the key's smallest record id). A hot key's smallest id is found before the shuffle and joined by ``skew_join``."""
    keyed = records.select("record_id", exact_key().alias("match_key")).where("match_key is not null").distinct()
    least = keyed.groupBy("match_key").agg(F.min("record_id").alias("group_id"))
    return skew_join(keyed, least, ["match_key"])


def merge_records(records: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """group_id, columns, members: each column from the richest record, blanks filled from the others by record id.

    All by aggregates that combine before the shuffle. Which records a group has is in ``groups``, a row each: a
    list in one row would hold a hot group in one task.
    """
    rich = sum((F.when(norm(c) != "", 1).otherwise(0) for c in columns), F.lit(0))
    latest = records.groupBy("record_id").agg(F.max_by(F.struct(*columns), F.struct("loaded_at", *columns)).alias("r")).select("record_id", "r.*")
    j = skew_join(latest.withColumn("_rich", rich), groups.select("record_id", "group_id").groupBy("record_id").agg(F.min("group_id").alias("group_id")), ["record_id"])
    # richest first, then by id; a blank value never wins over a filled one
    best = [F.min(F.when(norm(c) != "", F.struct((-F.col("_rich")).alias("o"), F.col("record_id").alias("i"), F.trim(c).alias("v"))))["v"].alias(c) for c in columns]
    return j.groupBy("group_id").agg(*best, F.count(F.lit(1)).alias("members"))


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character similarity of the longest-block matching kind."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def identifiers_conflict(a: str, b: str) -> Column:
    """Whether two rows name different identifiers of one kind."""
    bad = F.lit(False)
    for c in ("doi", "pmid", "pmcid", "arxiv_id"):
        x, y = filled(F.col(f"{a}.{c}")), filled(F.col(f"{b}.{c}"))
        bad = bad | F.coalesce(F.lower(x) != F.lower(y), F.lit(False))
    return bad


def years_fit(a: Column, b: Column) -> Column:
    """A blank year fits any; numbers within one; else equal texts."""
    x, y = norm(a), norm(b)
    n = lambda t: F.substring(t, 1, 4).try_cast("int")
    return (x == "") | (y == "") | F.coalesce(F.abs(n(x) - n(y)) <= 1, x == y)


def fuzzy_pairs(records: DataFrame, threshold: float = 0.93) -> DataFrame:
    """a, b, ratio of titles at least as similar as ``threshold``, between distinct normal titles of 20 or more characters with one first letter, fitting years and no conflicting identifiers.

    Candidates have a common subsequence of titles that is long enough (``similar.candidates``, lossless); they are verified exactly. Equal titles are one
    representative each (the smallest id), so copies don't multiply.
    """
    # letters only and single blanks, so lengths and letters are of what the ratio compares
    titled = records.select("record_id", "doi", "pmid", "pmcid", "arxiv_id", "year", L.norm_title_ascii(F.col("title")).alias("t")).where(F.length("t") >= 20)
    rep = titled.groupBy("t", "year").agg(F.min(F.struct("record_id", "doi", "pmid", "pmcid", "arxiv_id")).alias("r")).select("t", "year", "r.*")
    pairs = candidates(rep, "record_id", threshold)
    x, y = rep.alias("x"), rep.alias("y")
    cand = pairs.join(x, F.col("a") == F.col("x.record_id")).join(y, F.col("b") == F.col("y.record_id"))
    cand = cand.where((F.substring("x.t", 1, 1) == F.substring("y.t", 1, 1)) & years_fit(F.col("x.year"), F.col("y.year")) & ~identifiers_conflict("x", "y"))
    return cand.select("a", "b", title_ratio(F.col("x.t"), F.col("y.t")).alias("ratio")).where(F.col("ratio") >= threshold)


def duplicate_links(records: DataFrame, threshold: float = 0.93) -> DataFrame:
    """a, b: record ids whose titles of 20 or more characters are equal or similar, with fitting years and no conflicting identifiers.

    Records that agree in title, year and every identifier make a class, linked to its smallest id; years and identifiers are
    compared for every pair of classes, titles once. A ratio counts in either order, as a table has none.
    """

    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            m = difflib.SequenceMatcher(None, x, y)
            # the first two are upper bounds
            return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and (m.ratio() >= threshold or difflib.SequenceMatcher(None, y, x).ratio() >= threshold)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    parts = ["t", "year", "doi", "pmid", "pmcid", "arxiv_id"]
    ids = [L.norm_id(F.col(c)).alias(c) for c in parts[3:]]
    titled = records.where("record_id is not null").select("record_id", L.norm_title_ascii(F.col("title")).alias("t"), norm("year").alias("year"), L.norm_doi(F.col("doi")).alias("doi"), *ids).where(F.length("t") >= 20)
    classes = titled.groupBy(*parts).agg(F.min("record_id").alias("record_id"))
    same = titled.join(classes.withColumnRenamed("record_id", "a"), parts).select("a", F.col("record_id").alias("b"))
    x, y = classes.alias("x"), classes.alias("y")
    fit = years_fit(F.col("x.year"), F.col("y.year")) & ~identifiers_conflict("x", "y")
    ends = [F.col("x.record_id").alias("a"), F.col("y.record_id").alias("b")]
    equal = x.join(y, (F.col("x.t") == F.col("y.t")) & fit).select(*ends)
    alike = candidates(classes.select("t").distinct(), "t", threshold).withColumnRenamed("a", "ta").withColumnRenamed("b", "tb")
    # most pairs of titles have no two rows that fit, so the ratio, the dear part, comes last; told to be non-deterministic, it isn't moved before the joins
    near = alike.join(x, F.col("ta") == F.col("x.t")).join(y, (F.col("tb") == F.col("y.t")) & fit).where(similar.asNondeterministic()("ta", "tb")).select(*ends)
    return same.unionByName(equal).unionByName(near).where("a <> b").distinct()


def duplicate_groups(records: DataFrame, scratch: Scratch | None = None, threshold: float = 0.93) -> DataFrame:
    """record_id, group_id (the group's smallest record id) of every record, linked by key or by title; a record without links is its own group."""
    scratch = scratch or Scratch(records.sparkSession, "duplicates")
    exact = exact_groups(records).select(F.col("group_id").alias("a"), F.col("record_id").alias("b"))
    links = scratch.write(exact.unionByName(duplicate_links(records, threshold)), "links")
    comp = connected_components(links, "a", "b", scratch).withColumnRenamed("id", "record_id")
    return records.where("record_id is not null").select("record_id").distinct().join(comp, "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("group_id"))


def tfidf(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf, df, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length a document."""
    t = docs.select(key, F.explode(L.terms(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.countDistinct(key).alias("_n")).scalar()
    # document frequencies meet their terms with hot terms split off
    w = skew_join(t, df, ["term"]).withColumn("raw", (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    size = w.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_len"))
    return w.join(size, key).select(key, "term", "tf", "df", (F.col("raw") / F.col("_len")).alias("weight"))


def cosine_pairs(weights: DataFrame, key: str, threshold: float) -> DataFrame:
    """a, b, cosine at least ``threshold``, from unit vectors (key, term, df, weight).

    A pair's rarest shared term lies in both documents' prefixes, which end where the rest of the vector is
    shorter than the threshold; so only prefixes are joined, and candidates verified in full.
    """
    order = Window.partitionBy(key).orderBy("df", "term")
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(F.col("weight") ** 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    prefix = weights.withColumn("_rest", rest).where(F.col("_rest") >= threshold - 1e-9).select(key, "term")
    pairs = prefix.alias("p").join(prefix.alias("s"), (F.col("p.term") == F.col("s.term")) & (F.col(f"p.{key}") < F.col(f"s.{key}"))).select(F.col(f"p.{key}").alias("a"), F.col(f"s.{key}").alias("b")).distinct()
    wa = weights.select(F.col(key).alias("a"), "term", F.col("weight").alias("wa"))
    wb = weights.select(F.col(key).alias("b"), "term", F.col("weight").alias("wb"))
    return pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= threshold)


def threshold_clusters(weights: DataFrame, key: str, threshold: float = 0.23, scratch: Scratch | None = None) -> DataFrame:
    """key, cluster_id (C001 for the largest, then by smallest member), links: single linkage at a cosine threshold."""
    scratch = scratch or Scratch(weights.sparkSession, "clusters")
    pairs = scratch.write(cosine_pairs(weights, key, threshold), "pairs")
    comp = connected_components(pairs, "a", "b", scratch)
    ids = weights.select(key).distinct()
    member = ids.join(comp.withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_running(sizes.select("component", (-F.col("n")).alias("_neg"), F.lit(1).cast("long").alias("_one")), [], ["_neg", "component"], {"rank": ("_one", "sum", True)}, scratch, "ranked")
    named = ranked.withColumn("cluster_id", F.format_string("C%03d", "rank"))
    links = pairs.select(F.explode(F.array("a", "b")).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("links"))
    return skew_join(member, named.select("component", "cluster_id"), ["component"]).join(links, key, "left").select(key, "cluster_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def cluster_terms(weights: DataFrame, clusters: DataFrame, key: str, k: int = 8) -> DataFrame:
    """cluster_id, rank, term, weight: the terms of the greatest summed weight in each cluster (ties by term).

    The limit per cluster is applied before the shuffle as well, so a large cluster sends k rows a task.
    """
    w = skew_join(weights.select(key, "term", "weight"), clusters.select(key, "cluster_id"), [key]).groupBy("cluster_id", "term").agg(F.sum("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("weight").desc(), "term"))
    return w.withColumn("rank", rank).where(F.col("rank") <= k).select("cluster_id", "rank", "term", "weight")
