"""Figure specifications and benchmark records: references, geometry, legibility, scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import ledger as L
from auditloom.functions.text import norm
from auditloom.operators.findings import finding, union

BOX = ("x", "y", "w", "h")


def specification(entities: DataFrame, relations: DataFrame, kinds: list[str]) -> DataFrame:
    """entities(id, label), relations(id, source, target, type): repeated ids, ends that don't exist, unknown types, blank labels."""
    ids = entities.select("id").distinct()
    end = lambda c: relations.select(F.col("id").alias("r"), F.col(c).alias("id")).join(ids, "id", "left_anti")
    every = entities.select("id").unionByName(relations.select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return union([
        finding(every, "error", "repeated_id", F.col("id"), F.col("n").cast("string")),
        finding(end("source"), "error", "no_such_source", F.col("r"), F.coalesce("id", F.lit(""))),
        finding(end("target"), "error", "no_such_target", F.col("r"), F.coalesce("id", F.lit(""))),
        finding(relations.where(~F.coalesce(F.col("type").isin(*kinds), F.lit(False))), "error", "unknown_relation", F.col("id"), F.coalesce("type", F.lit(""))),
        finding(entities.where(norm("label") == ""), "warning", "no_label", F.col("id"), F.lit("the entity has no label")),
    ])


def grounding(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """claims(id, anchor_ids), anchors(id): claims without anchors, anchors that don't exist or that nothing uses."""
    used = claims.select(F.col("id").alias("claim"), F.explode("anchor_ids").alias("id"))
    return union([
        finding(claims.where("anchor_ids is null or size(anchor_ids) = 0"), "error", "ungrounded", F.col("id"), F.lit("the claim has no anchor")),
        finding(used.join(anchors.select("id"), "id", "left_anti"), "error", "no_such_anchor", F.col("claim"), F.coalesce("id", F.lit(""))),
        finding(anchors.join(used.select("id").distinct(), "id", "left_anti"), "warning", "unused_anchor", F.col("id"), F.lit("no claim uses it")),
    ])


def labels_shown(required: DataFrame, elements: DataFrame) -> DataFrame:
    """required(id, label), elements(id, text): elements that are missing or don't show their label."""
    j = required.join(elements.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")), "id", "left")
    return union([
        finding(j.where("text is null"), "error", "not_drawn", F.col("id"), F.lit("no element has this id")),
        finding(j.where(F.col("text").isNotNull() & ~F.lower("text").contains(F.lower("label"))), "error", "label_not_shown", F.col("id"), F.col("label")),
    ])


def route_gaps(entities: DataFrame, relations: DataFrame, most: float) -> DataFrame:
    """entities(id, x, y, w, h), relations(id, source, target, x1, y1, x2, y2): ends of a route farther than ``most`` from their entity."""
    box = [F.col(f"e.{c}") for c in BOX]

    def side(at: str, x: str, y: str) -> DataFrame:
        j = relations.alias("r").join(entities.alias("e"), F.col(f"r.{at}") == F.col("e.id"))
        d = L.point_to_box(F.col(f"r.{x}"), F.col(f"r.{y}"), *box)
        return finding(j.where(d > most), "error", f"{at}_gap", F.col("r.id"), F.round(d, 3).cast("string"))

    return union([side("source", "x1", "y1"), side("target", "x2", "y2")])


def box_overlaps(entities: DataFrame, contained: DataFrame, least: float, cell: float = 200.0) -> DataFrame:
    """a, b, ratio of boxes that overlap by at least ``least`` of the smaller, without the pairs of contained(parent, child).

    Boxes meet only in the grid cells they touch, and a pair counts in the first one that both touch; no pair of
    distant boxes is ever formed.
    """
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell))
    g = entities.select("id", *BOX).withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    a, b = g.alias("a"), g.alias("b")
    ratio = L.overlap_ratio(*[F.col(f"a.{c}") for c in BOX], *[F.col(f"b.{c}") for c in BOX])
    first = (F.col("a.cx") == F.floor(F.greatest("a.x", "b.x") / cell)) & (F.col("a.cy") == F.floor(F.greatest("a.y", "b.y") / cell))
    j = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id"))).where(first)
    pairs = j.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), ratio.alias("ratio")).where((F.col("ratio") > 0) & (F.col("ratio") >= least))
    inside = contained.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    return pairs.join(inside, ["a", "b"], "left_anti")


def legibility(texts: DataFrame, width_in: float, least: float) -> DataFrame:
    """texts(id, font_size, view_width): texts printed smaller than ``least`` points."""
    size = L.final_point_size(F.col("font_size"), F.col("view_width"), F.lit(width_in))
    return finding(texts.where(size < least), "error", "too_small", F.col("id"), F.concat(F.round(size, 2).cast("string"), F.lit(" pt")))


# fixed values: what a figure's parts weigh, and from which score on a level holds
WEIGHTS = {"entities": 1.0, "relations": 0.75, "panels": 2.0, "core_claims": 0.75, "feedback": 0.75}
LEVELS = {"high": 14.0, "medium": 8.0}
FEEDBACK = ("feeds_back", "contains", "compares_with")


def complexity(specs: DataFrame) -> DataFrame:
    """specs(id, counts of entities, relations, panels, core_claims, and of relations of the types ``FEEDBACK``) -> score and level; the first panel and the first two core claims weigh nothing."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = {"entities": n("entities"), "relations": n("relations"), "panels": F.greatest(n("panels") - 1, F.lit(0)), "core_claims": F.greatest(n("core_claims") - 2, F.lit(0)), "feedback": n("feedback")}
    score = sum((c * WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    return specs.select("id", score.alias("score"), F.when(score >= LEVELS["high"], "high").when(score >= LEVELS["medium"], "medium").otherwise("low").alias("level"))


def gate(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """scores(id, metric columns): metrics below their threshold."""
    low = F.filter(F.array(*[F.when(F.coalesce(F.col(m) < t, F.lit(True)), F.lit(m)) for m, t in thresholds.items()]), lambda x: x.isNotNull())
    return finding(scores.select("id", F.explode(low).alias("m")), "error", "below_threshold", F.col("id"), F.col("m"))


SCORES = ("scientific_accuracy", "coverage", "clarity", "hierarchy", "legibility", "aesthetics", "editability")
SEVERITIES = ("critical", "major", "minor")


def evaluation_records(evals: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """evals(case_id, run_id, scores map, failures array<struct<category,severity>>): scores missing or outside 0 to 10, unknown severities, repeated runs."""
    e = F.concat_ws("/", "case_id", "run_id")
    need = F.array(*[F.lit(s) for s in scores])
    each = evals.select("case_id", "run_id", F.explode("scores").alias("name", "v"))
    sev = evals.select("case_id", "run_id", F.explode("failures.severity").alias("s"))
    return union([
        finding(evals.select("case_id", "run_id", F.explode(F.array_except(need, F.map_keys("scores"))).alias("m")), "error", "score_missing", e, F.col("m")),
        finding(each.where("v is null or isnan(v) or v < 0 or v > 10"), "error", "score_range", e, F.col("name")),
        finding(sev.where(~F.coalesce(F.col("s").isin(*SEVERITIES), F.lit(False))), "error", "severity", e, F.coalesce("s", F.lit(""))),
        finding(evals.groupBy("case_id", "run_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "error", "repeated_run", e, F.col("k").cast("string")),
    ])


def paired_scores(evals: DataFrame, baseline: str, candidate: str, metric: str) -> DataFrame:
    """case_id, a, b, delta of cases with exactly one run of each variant: evals(case_id, variant, scores)."""
    v = F.col("scores")[metric]
    side = lambda n: F.max(F.when(F.col("variant") == n, v))
    k = lambda n: F.count(F.when(F.col("variant") == n, 1))
    return evals.groupBy("case_id").agg(side(baseline).alias("a"), side(candidate).alias("b"), k(baseline).alias("ka"), k(candidate).alias("kb")).where("ka = 1 and kb = 1").select("case_id", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def win_tie_loss(pairs: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    d = F.col("delta")
    return pairs.agg(F.count(d).alias("cases"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("mean_delta"), n(d > 0).alias("wins"), n(d == 0).alias("ties"), n(d < 0).alias("losses"))


def failure_counts(evals: DataFrame) -> DataFrame:
    """severity, category, n: counts by both, and subtotals where one is null (grouping sets)."""
    f = evals.select(F.explode("failures").alias("f")).select(F.coalesce("f.severity", F.lit("")).alias("severity"), F.coalesce("f.category", F.lit("")).alias("category"))
    return f.cube("severity", "category").agg(F.count(F.lit(1)).alias("n"))


def suite_integrity(suite: DataFrame, files: DataFrame) -> DataFrame:
    """suite(variant_id, parent_id, path, sha256), files(path, sha256): changed or missing files and parents that don't exist."""
    j = suite.join(files.select("path", F.col("sha256").alias("now")), "path", "left")
    kids = suite.where(norm("parent_id") != "").select("variant_id", F.col("parent_id").alias("p"))
    return union([
        finding(j.where("now is null"), "error", "file_missing", F.col("variant_id"), F.col("path")),
        finding(j.where("now is not null and lower(now) <> lower(sha256)"), "error", "file_changed", F.col("variant_id"), F.col("path")),
        finding(kids.join(suite.select(F.col("variant_id").alias("p")), "p", "left_anti"), "error", "no_such_parent", F.col("variant_id"), F.col("p")),
    ])


_STEP = re.compile(r"([MLHVCSQTAZmlhvcsqtaz])([^MLHVCSQTAZmlhvcsqtaz]*)")
_TAKES = {"M": 2, "L": 2, "T": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "A": 7, "Z": 0}


def path_ends(d: str) -> tuple[float, float, float, float] | None:
    """Start and end points of an SVG path; None where it can't be read."""
    x = y = 0.0
    start: tuple[float, float] | None = None
    home = (0.0, 0.0)
    for cmd, args in _STEP.findall(d or ""):
        nums = [float(n) for n in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", args)]
        k, up = _TAKES[cmd.upper()], cmd.upper()
        if k == 0:
            x, y = home
            continue
        if not nums or len(nums) % k:
            return None
        for i in range(0, len(nums), k):
            p = nums[i : i + k]
            rel = cmd.islower()
            if up == "H":
                x = p[0] + (x if rel else 0)
            elif up == "V":
                y = p[0] + (y if rel else 0)
            else:
                x, y = p[-2] + (x if rel else 0), p[-1] + (y if rel else 0)
            if up == "M" and i == 0:
                home = (x, y)
                start = start or home
    return None if start is None else (*start, x, y)


@F.pandas_udf(T.StructType([T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()), T.StructField("x2", T.DoubleType()), T.StructField("y2", T.DoubleType())]))
def svg_path_ends(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([path_ends(d) or (None,) * 4 for d in s], columns=["x1", "y1", "x2", "y2"])


def enum_check(df: DataFrame, ident: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Review records: columns whose value isn't one of the allowed ones."""
    bad = F.filter(F.array(*[F.when(~F.coalesce(F.col(c).isin(*vs), F.lit(False)), F.lit(c)) for c, vs in allowed.items()]), lambda x: x.isNotNull())
    return finding(df.select(ident, F.explode(bad).alias("c")), "error", "not_allowed", F.col(ident), F.col("c"))


def readiness(checks: DataFrame) -> DataFrame:
    """checks(dimension, required, ok, blocked) -> dimension, status."""
    n = lambda c: F.count(F.when(c, 1))
    a = checks.groupBy("dimension").agg(F.count(F.lit(1)).alias("k"), n(F.col("ok")).alias("good"), n(F.coalesce(F.col("blocked"), F.lit(False))).alias("stop"), n(F.col("ok").isNotNull()).alias("seen"))
    status: Column = F.when(F.col("stop") > 0, "blocked").when(F.col("seen") == 0, "not_checked").when(F.col("good") == F.col("k"), "ready").when(F.col("good") > 0, "partial").otherwise("missing")
    return a.select("dimension", status.alias("status"))
