"""Analysis plans: a validated specification compiled to one-row comparisons, multiplicity and sensitivity.

A plan is a dict: ``analyses`` (items with id, type, roles of columns and levels), ``multiplicity`` (family ->
method), ``sensitivity`` (base item, filters, overrides). Validation reads only the plan; running an item is one
distributed pass (two for regressions' errors).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import dist
from auditloom.operators import clean, stats
from auditloom.operators.quantiles import quantiles
from auditloom.scratch import Scratch

# fixed values: the inference types and what each item must name
NEEDS = {
    "independent_t": ("group", "outcome", "level_a", "level_b"), "equivalence_tost_independent": ("group", "outcome", "level_a", "level_b", "low", "high"), "paired_t": ("pair", "condition", "outcome", "level_a", "level_b"), "equivalence_tost_paired": ("pair", "condition", "outcome", "level_a", "level_b", "low", "high"),
    "mann_whitney": ("group", "outcome", "level_a", "level_b"), "wilcoxon": ("pair", "condition", "outcome", "level_a", "level_b"), "pearson": ("x", "y"), "spearman": ("x", "y"),
    "linear_regression": ("outcome", "predictors"), "ancova_two_group": ("outcome", "group", "level_a", "level_b", "covariates"), "logistic_regression": ("outcome", "predictors", "event"), "poisson_regression": ("outcome", "predictors"),
    "welch_anova": ("group", "outcome", "levels"), "welch_contrast": ("group", "outcome", "weights"), "chi_square": ("row", "col"), "fisher_exact": ("row", "col"),
}
METHODS = ("none", "bonferroni", "holm", "bh")
FILTERS = ("eq", "ne", "in", "not_in", "isna", "notna", "lt", "le", "gt", "ge")
RESULT = "item_id string, type string, family string, n long, estimate double, ci_low double, ci_high double, statistic double, p_value double, effect_size double, problem string, method string"


def validate(plan: dict) -> list[tuple[str, str, str]]:
    """(severity, item, message) of everything that is wrong with a plan."""
    out: list[tuple[str, str, str]] = []
    seen: set[str] = set()
    for i, a in enumerate(plan.get("analyses") or []):
        name = a.get("id") or f"#{i}"
        if name in seen:
            out.append(("error", name, "the id occurs twice"))
        seen.add(name)
        if a.get("type") not in NEEDS:
            out.append(("error", name, f"unknown type {a.get('type')}"))
            continue
        out += [("error", name, f"{k} is missing") for k in NEEDS[a["type"]] if a.get(k) in (None, "", [], {})]
        if not 0 < (a.get("level") or 0.95) < 1:
            out.append(("error", name, "the confidence level lies outside 0 and 1"))
        if a.get("level_a") is not None and type(a.get("level_a")) is type(a.get("level_b")) and a.get("level_a") == a.get("level_b"):
            out.append(("error", name, "both levels are the same"))
        if a["type"] == "welch_anova" and len(a.get("levels") or []) < 3:
            out.append(("error", name, "an omnibus test needs three levels"))
        if a["type"] == "welch_contrast" and abs(sum((a.get("weights") or {}).values())) > 1e-9:
            out.append(("error", name, "contrast weights must add up to 0"))
        if "tost" in a["type"] and not (a.get("low") or 0) < (a.get("high") or 0):
            out.append(("error", name, "equivalence bounds are not in order"))
        if a["type"] == "poisson_regression" and a.get("robust") == "HC3":
            out.append(("error", name, "HC3 is for least squares"))
    if not seen:
        out.append(("error", "", "the plan has no analyses"))
    fams = {a.get("family") for a in plan.get("analyses") or [] if a.get("family")}
    for f, m in (plan.get("multiplicity") or {}).items():
        if m not in METHODS:
            out.append(("error", f, f"unknown adjustment {m}"))
        if f not in fams:
            out.append(("warning", f, "no analysis is in this family"))
    for s in plan.get("sensitivity") or []:
        if s.get("base") not in seen:
            out.append(("error", s.get("id") or "", "its base is no analysis of the plan"))
        out += [("error", s.get("id") or "", f"unknown filter {op}") for _, op, *_ in s.get("filters") or [] if op not in FILTERS]
        base = next((a for a in plan.get("analyses") or [] if a.get("id") == s.get("base")), {})
        if s.get("same_estimand") and any(k in (s.get("override") or {}) and s["override"][k] != base.get(k) for k in ("type", "outcome", "group", "level_a", "level_b")):
            out.append(("error", s.get("id") or "", "an override changes the estimand it claims to keep"))
    return out


def run_item(df: DataFrame, a: dict, scratch: Scratch) -> DataFrame:
    """One row of ``RESULT``: degenerate data give a problem, not zeros."""
    kind, level = a["type"], a.get("level") or 0.95
    none = F.lit(None).cast("double")
    row = lambda r, **c: r.select(*[c.get(n, none).cast(t).alias(n) for n, t in (x.split(" ") for x in "n long, estimate double, ci_low double, ci_high double, statistic double, df double, df2 double, effect_size double, se double, tail string, problem string".split(", "))])
    c = F.col
    text = F.lit
    if kind in ("independent_t", "equivalence_tost_independent"):
        r = stats.welch(df, a["group"], a["outcome"], a["level_a"], a["level_b"])
        n = c("n_a") + c("n_b")
        if kind == "independent_t":
            r = row(r, n=n, estimate=c("estimate"), se=c("se"), df=c("df"), statistic=c("statistic"), effect_size=c("effect_size"), tail=text("t"), problem=c("problem"))
        else:
            r = row(stats.tost(r, a["low"], a["high"]), n=n, estimate=c("estimate"), se=c("se"), df=c("df"), statistic=c("statistic"), effect_size=c("effect_size"), tail=text("tost"), problem=c("problem"))
    elif kind in ("paired_t", "equivalence_tost_paired"):
        r = stats.paired(stats.paired_values(df, a["pair"] if isinstance(a["pair"], list) else [a["pair"]], a["condition"], a["outcome"], a["level_a"], a["level_b"]))
        bad = F.when(F.coalesce(c("se"), F.lit(0.0)) <= 0, "all differences are the same")
        r = stats.tost(r, a["low"], a["high"]) if kind != "paired_t" else r
        r = row(r, n=c("n"), estimate=c("estimate"), se=c("se"), df=c("df"), statistic=c("statistic"), effect_size=c("effect_size"), tail=text("t" if kind == "paired_t" else "tost"), problem=bad)
    elif kind == "mann_whitney":
        r = stats.mann_whitney(df, a["group"], a["outcome"], a["level_a"], a["level_b"], scratch)
        r = row(r, n=c("n_a") + c("n_b"), estimate=c("u"), statistic=c("z"), effect_size=c("effect_size"), tail=F.concat(F.lit("u:"), F.concat_ws(",", *[c(x).cast("string") for x in ("u", "n_a", "n_b", "ties")])), problem=F.when((c("n_a") == 0) | (c("n_b") == 0), "a level has no rows"))
    elif kind == "wilcoxon":
        r = stats.wilcoxon(stats.paired_values(df, a["pair"] if isinstance(a["pair"], list) else [a["pair"]], a["condition"], a["outcome"], a["level_a"], a["level_b"]), scratch)
        mean, sd = c("n") * (c("n") + 1) / 4.0, F.sqrt(c("n") * (c("n") + 1) * (2 * c("n") + 1) / 24.0 - c("ties") / 48.0)
        r = row(r, n=c("n"), estimate=c("w"), statistic=F.try_divide(c("w_plus") - mean, sd), effect_size=c("effect_size"), tail=F.concat(F.lit("w:"), F.concat_ws(",", *[c(x).cast("string") for x in ("w_plus", "n", "ties", "zeros")])), problem=F.when(F.coalesce(c("n"), F.lit(0)) == 0, "all differences are 0"))
    elif kind == "pearson":
        r = stats.pearson(df, a["x"], a["y"])
        t = c("estimate") * F.sqrt((c("n") - 2) / (1 - c("estimate") ** 2))
        z = F.lit(dist.norm_ppf(0.5 + level / 2)) * c("se_z")
        r = row(r, n=c("n"), estimate=c("estimate"), ci_low=F.tanh(c("fisher_z") - z), ci_high=F.tanh(c("fisher_z") + z), statistic=t, df=c("n") - 2, effect_size=c("estimate"), tail=text("stat"), problem=F.when(c("estimate").isNull() | F.isnan("estimate"), "a column is constant"))
    elif kind == "spearman":
        r = stats.spearman(df, a["x"], a["y"], scratch)
        r = row(r, n=c("n"), estimate=c("estimate"), statistic=c("estimate") * F.sqrt((c("n") - 2) / (1 - c("estimate") ** 2)), df=c("n") - 2, effect_size=c("estimate"), tail=text("stat"), problem=F.when(c("estimate").isNull() | F.isnan("estimate"), "a column is constant"))
    elif kind in ("linear_regression", "ancova_two_group"):
        if kind == "ancova_two_group":
            df = df.where(c(a["group"]).isin(a["level_a"], a["level_b"])).withColumn("_arm", (c(a["group"]) == F.lit(a["level_b"])).cast("double"))
            xs, focus = ["_arm", *a["covariates"]], "_arm"
        else:
            xs, focus = list(a["predictors"]), a.get("focus") or a["predictors"][0]
        robust = a.get("robust") or "HC3"
        r = row(stats.ols(df, a["outcome"], xs, robust).where(c("term") == focus), n=c("n"), estimate=c("estimate"), se=c("se"), df=c("df"), statistic=c("statistic"), effect_size=c("r2"), tail=text("t" if robust == "nonrobust" else "normal"))
    elif kind in ("logistic_regression", "poisson_regression"):
        fam = "binomial" if kind == "logistic_regression" else "poisson"
        y = a["outcome"]
        if fam == "binomial":
            df = df.withColumn("_y", F.when(c(y).isNotNull(), (c(y) == F.lit(a["event"])).cast("double")))
            y = "_y"
        if a.get("exposure"):
            df = df.withColumn("_offset", F.log(c(a["exposure"])))
        focus = a.get("focus") or a["predictors"][0]
        r = row(stats.glm(df, y, list(a["predictors"]), fam, "_offset" if a.get("exposure") else None).where(c("term") == focus), n=c("n"), estimate=c("estimate"), se=c("se"), statistic=c("statistic"), effect_size=c("ratio"), tail=text("normal"))
    elif kind == "welch_anova":
        r = row(stats.welch_anova(df, a["group"], a["outcome"], a["levels"]), n=c("n"), statistic=c("statistic"), df=c("df1"), df2=c("df2"), effect_size=c("effect_size"), tail=text("f"), problem=c("problem"))
    elif kind == "welch_contrast":
        r = row(stats.welch_contrast(df, a["group"], a["outcome"], a["weights"]), estimate=c("estimate"), se=c("se"), df=c("df"), statistic=c("statistic"), tail=text("t"), problem=c("problem"))
    elif kind == "chi_square":
        r = row(stats.chi_square(df, a["row"], a["col"]), n=c("n"), statistic=c("statistic"), df=c("df"), effect_size=c("effect_size"), tail=text("chi2"), problem=c("problem"))
    else:
        f = stats.fisher(df, a["row"], a["col"], a.get("row_levels"), a.get("col_levels"), level)
        packed = F.concat_ws(",", *[c(x).cast("string") for x in "abcd"])
        r = row(f, n=c("a") + c("b") + c("c") + c("d"), estimate=c("estimate"), ci_low=c("ci_low"), ci_high=c("ci_high"), effect_size=c("estimate"), tail=F.concat(F.lit("fisher:"), packed), problem=c("problem"))
    low, high = a.get("low"), a.get("high")

    def tails(batches):
        for b in batches:
            out = b.copy()
            ps, lows, highs, how = [], [], [], []
            for x in b.itertuples():
                p, ci, m = None, (x.ci_low, x.ci_high), None if x.tail is None else x.tail.split(":")[0]
                ok = x.problem is None and x.tail is not None
                stat = None if x.statistic is None or (isinstance(x.statistic, float) and math.isnan(x.statistic)) else x.statistic
                if ok and x.tail.startswith("fisher:"):
                    p = dist.hypergeom_two_sided(*map(int, x.tail[7:].split(",")))
                elif ok and stat is not None:
                    if x.tail == "t":
                        p, h = dist.t_two_sided(stat, x.df), dist.t_ppf(0.5 + level / 2, x.df) * x.se
                        ci = (x.estimate - h, x.estimate + h)
                    elif x.tail == "tost":
                        p = max(1 - dist.t_cdf((x.estimate - low) / x.se, x.df), dist.t_cdf((x.estimate - high) / x.se, x.df))
                        h = dist.t_ppf(level, x.df) * x.se
                        ci = (x.estimate - h, x.estimate + h)
                    elif x.tail == "normal":
                        p, h = 2 * (1 - dist.norm_cdf(abs(stat))), dist.norm_ppf(0.5 + level / 2) * x.se
                        ci = (x.estimate - h, x.estimate + h)
                    elif m in ("u", "w"):
                        v, n1, n2, ties = x.tail[2:].split(",") if m == "u" else [(q := x.tail[2:].split(","))[0], q[1], q[3], q[2]]
                        # as is usual: exact for a small sample without ties (and without zeros)
                        small = float(ties) == 0 and (min(int(n1), int(n2)) <= 8 and int(n1) * int(n2) <= dist.MAX_CELLS if m == "u" else int(n1) <= 50 and int(n2) == 0)
                        p = (dist.mann_whitney_exact(float(v), int(n1), int(n2)) if m == "u" else dist.wilcoxon_exact(float(v), int(n1))) if small else 2 * (1 - dist.norm_cdf(abs(stat)))
                        m = "exact" if small else "normal"
                    elif x.tail == "stat":
                        p = dist.t_two_sided(stat, x.df)
                    elif x.tail == "f":
                        p = dist.f_sf(stat, x.df, x.df2)
                    elif x.tail == "chi2":
                        p = dist.chi2_sf(stat, x.df)
                ps.append(p)
                how.append(m if p is not None else None)
                lows.append(ci[0])
                highs.append(ci[1])
            out["p_value"], out["ci_low"], out["ci_high"] = pd.Series(ps, dtype="float64"), pd.Series(lows, dtype="float64"), pd.Series(highs, dtype="float64")
            yield pd.DataFrame({"item_id": [a["id"]] * len(b), "type": [kind] * len(b), "family": [a.get("family")] * len(b)} | {k: out[k] for k in ("n", "estimate", "ci_low", "ci_high", "statistic", "p_value", "effect_size", "problem")} | {"method": how})

    return r.mapInPandas(tails, RESULT)


def run(df: DataFrame, plan: dict, scratch: Scratch | None = None) -> DataFrame:
    """Results of all items, with ``p_adjusted`` by each family's method and what sensitivity runs change (``base_id``, ``delta``)."""
    wrong = [m for m in validate(plan) if m[0] == "error"]
    if wrong:
        raise ValueError(f"the plan is invalid: {wrong[:5]}")
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "analysis")
    parts = [run_item(df, a, scratch) for a in plan["analyses"]]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = scratch.write(rows, "results")
    method = plan.get("multiplicity") or {}
    adjusted = stats.adjust(rows.where("family is not null"), ["family"], "p_value", ["item_id"], scratch).unionByName(rows.where("family is null").withColumns({c: F.lit(None).cast("double") for c in ("p_bonferroni", "p_holm", "p_bh")}))
    pick = F.lit(None).cast("double")
    for f, m in method.items():
        pick = F.when((F.col("family") == f) & F.lit(m != "none"), F.col(f"p_{m if m != 'none' else 'holm'}")).otherwise(pick)
    base = adjusted.withColumn("p_adjusted", F.coalesce(pick, F.col("p_value"))).drop("p_bonferroni", "p_holm", "p_bh").withColumn("base_id", F.lit(None).cast("string")).withColumn("delta", F.lit(None).cast("double"))
    out = base
    items = {a["id"]: a for a in plan["analyses"]}
    for s in plan.get("sensitivity") or []:
        a = items[s["base"]] | (s.get("override") or {}) | {"id": s["id"], "family": None}
        kept = clean.exclude_any(df, [tuple(f) for f in s["filters"]]) if s.get("filters") else df
        r = run_item(kept, a, scratch).withColumn("p_adjusted", F.lit(None).cast("double")).withColumn("base_id", F.lit(s["base"]))
        was = rows.where(F.col("item_id") == s["base"]).select(F.col("item_id").alias("base_id"), F.col("estimate").alias("_was"))
        # a difference only means something for the same estimand
        delta = F.when(F.lit(bool(s.get("same_estimand"))), F.col("estimate") - F.col("_was"))
        out = out.unionByName(r.join(was, "base_id").withColumn("delta", delta).drop("_was"))
    return out


def describe(df: DataFrame, group: str, outcome: str, scratch: Scratch | None = None) -> DataFrame:
    """group, n, mean, sd, q1, median, q3."""
    scratch = scratch or Scratch(df.sparkSession, "describe")
    q = quantiles(df, [group], outcome, {"q1": 0.25, "median": 0.5, "q3": 0.75}, scratch)
    return df.where(F.col(outcome).isNotNull()).groupBy(group).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("sd")).join(q, group)
