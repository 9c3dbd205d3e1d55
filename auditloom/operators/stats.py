"""Prespecified comparisons as one-row aggregates.

Each function makes one distributed pass to sufficient statistics (combined before any shuffle) and
closed-form columns over the single resulting row; tails of distributions are added by ``inference``, an
Arrow UDF over that row. Degenerate inputs (zero variance, too few rows) give null estimates with a
``problem`` instead of zeros.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import dist
from auditloom.operators.ordering import with_running
from auditloom.operators.quantiles import value_counts_with_rank
from auditloom.operators.skew import skew_join
from auditloom.scratch import Scratch


def _num(c: str) -> Column:
    """A number; NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _arm(y: Column, cond: Column, s: str) -> list[Column]:
    v = F.when(cond, y)
    return [F.count(v).alias(f"n_{s}"), F.avg(v).alias(f"mean_{s}"), F.var_samp(v).alias(f"var_{s}")]


def welch(df: DataFrame, group: str, y: str, a: object, b: object) -> DataFrame:
    """mean_b - mean_a with unequal variances: estimate, se, df, statistic, effect_size (Hedges g)."""
    g = F.col(group)
    r = df.agg(*_arm(_num(y), g == F.lit(a), "a"), *_arm(_num(y), g == F.lit(b), "b"))
    qa, qb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    r = r.withColumn("estimate", F.col("mean_b") - F.col("mean_a")).withColumn("se", F.sqrt(qa + qb))
    r = r.withColumn("df", F.when(F.col("se") > 0, (qa + qb) ** 2 / (qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    j = 1 - 3.0 / (4 * (F.col("n_a") + F.col("n_b") - 2) - 1)
    return r.withColumn("statistic", F.when(F.col("se") > 0, F.col("estimate") / F.col("se"))).withColumn("effect_size", F.when(pooled > 0, F.col("estimate") / pooled * j)).withColumn("problem", F.when(F.coalesce(F.col("se"), F.lit(0.0)) <= 0, "zero variance or too few rows"))


def tost(r: DataFrame, low: float, high: float) -> DataFrame:
    """Two one-sided tests of equivalence over a row of ``welch`` or ``paired``: statistic_low, statistic_high, statistic."""
    r = r.withColumn("statistic_low", (F.col("estimate") - low) / F.col("se")).withColumn("statistic_high", (F.col("estimate") - high) / F.col("se"))
    return r.withColumn("statistic", F.least(F.col("statistic_low"), -F.col("statistic_high")))


def paired_values(df: DataFrame, key: list[str], condition: str, y: str, a: object, b: object) -> DataFrame:
    """key, a, b for keys with exactly one value under each condition (null keys form no pair)."""
    g = F.col(condition)
    v = lambda lvl: F.max(F.when(g == F.lit(lvl), _num(y)))
    n = lambda lvl: F.count(F.when(g == F.lit(lvl), 1))
    known = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in key])
    return df.where(known & g.isin(a, b)).groupBy(*key).agg(v(a).alias("a"), v(b).alias("b"), n(a).alias("n_a"), n(b).alias("n_b")).where("n_a = 1 and n_b = 1 and a is not null and b is not null").drop("n_a", "n_b")


def paired(pairs: DataFrame) -> DataFrame:
    """b - a over pairs: n, estimate, sd, se, df, statistic, effect_size (dz), skewness (bias-corrected)."""
    d = F.col("b") - F.col("a")
    r = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("estimate"), F.stddev_samp(d).alias("sd"), F.skewness(d).alias("g1"))
    n = F.col("n")
    r = r.withColumn("se", F.col("sd") / F.sqrt(n)).withColumn("df", (n - 1).cast("double")).withColumn("statistic", F.when(F.col("se") > 0, F.col("estimate") / F.col("se"))).withColumn("effect_size", F.when(F.col("sd") > 0, F.col("estimate") / F.col("sd")))
    return r.withColumn("skewness", F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))).drop("g1")


def mann_whitney(df: DataFrame, group: str, y: str, a: object, b: object, scratch: Scratch) -> DataFrame:
    """n_a, n_b, u (of b), effect_size (rank-biserial), ties, z (tie-corrected, continuity-corrected)."""
    g = F.col(group)
    two = df.where(g.isin(a, b)).select(_num(y).alias("v"), (g == F.lit(a)).cast("long").alias("a"), (g == F.lit(b)).cast("long").alias("b"))
    ranked = value_counts_with_rank(two, "v", ["a", "b"], scratch)
    r = ranked.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("midrank") * F.col("b")).alias("rb"), F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("ties"))
    na, nb = F.col("n_a"), F.col("n_b")
    n = (na + nb).cast("double")
    r = r.withColumn("u", F.col("rb") - nb * (nb + 1) / 2.0).withColumn("effect_size", F.try_divide(2 * F.col("u"), na * nb) - 1)
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    mid = na * nb / 2.0
    return r.withColumn("z", F.try_divide(F.abs(F.col("u") - mid) - 0.5, sd) * F.signum(F.col("u") - mid)).drop("rb")


def wilcoxon(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """n (nonzero), w_plus, w_minus, w, effect_size (matched rank-biserial), ties, zeros (pairs without a difference)."""
    d = F.col("b") - F.col("a")
    zeros = pairs.agg(F.count(F.when(d == 0, 1)).alias("z")).scalar()
    two = pairs.select(d.alias("d")).where("d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).cast("long").alias("p"))
    ranked = value_counts_with_rank(two, "v", ["p"], scratch)
    r = ranked.agg(F.sum("_t").alias("n"), F.sum(F.col("midrank") * F.col("p")).alias("w_plus"), F.sum(F.col("midrank") * (F.col("_t") - F.col("p"))).alias("w_minus"), F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("ties"))
    return r.withColumn("w", F.least("w_plus", "w_minus")).withColumn("effect_size", F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus"))).withColumn("zeros", zeros)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r and Fisher z of complete pairs."""
    return df.select(_num(x).alias("x"), _num(y).alias("y")).dropna().agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("estimate")).withColumn("fisher_z", F.atanh("estimate")).withColumn("se_z", F.when(F.col("n") > 3, 1 / F.sqrt(F.col("n") - 3)))


def spearman(df: DataFrame, x: str, y: str, scratch: Scratch) -> DataFrame:
    """Pearson on midranks; each side's ranks are looked up by value, so ties cost nothing."""
    both = df.select(_num(x).alias("x"), _num(y).alias("y")).dropna()
    side = lambda c: value_counts_with_rank(both, c, [], scratch, f"rank_{c}").select(F.col("_v").alias(c), F.col("midrank").alias(f"r_{c}"))
    return both.join(side("x"), "x").join(side("y"), "y").agg(F.count(F.lit(1)).alias("n"), F.corr("r_x", "r_y").alias("estimate"))


def welch_anova(df: DataFrame, group: str, y: str, levels: list) -> DataFrame:
    """Welch's omnibus test over declared levels: k, n, statistic, df1, df2, effect_size (Cohen's f by Welch's weights), outside (rows of other levels), problem.

    Every declared level needs two values and a variance above 0; otherwise its name is in ``problem`` and the results are null.
    """
    g = F.col(group)
    r = df.agg(*[c for i, lvl in enumerate(levels) for c in _arm(_num(y), g == F.lit(lvl), str(i))], F.count(F.when(g.isNotNull() & ~g.isin(*levels), 1)).alias("outside"))
    each = F.array(*[F.struct(F.lit(str(lvl)).alias("level"), F.col(f"n_{i}").alias("n"), F.col(f"mean_{i}").alias("m"), F.col(f"var_{i}").alias("v"), F.try_divide(F.col(f"n_{i}"), F.col(f"var_{i}")).alias("w")) for i, lvl in enumerate(levels)])
    bad = F.filter("each", lambda e: (e["n"] < 2) | ~F.coalesce((e["v"] > 0) & (e["v"] < float("inf")), F.lit(False)))
    few = F.when(F.size(bad) > 0, F.concat(F.lit("level "), bad[0]["level"], F.when(bad[0]["n"] < 2, " has fewer than two values").otherwise(" has no variance")))
    total = lambda f: F.aggregate("each", F.lit(0.0), lambda acc, e: acc + f(e))
    r = r.withColumn("each", each).withColumn("problem", few).withColumn("n", F.aggregate("each", F.lit(0).cast("long"), lambda acc, e: acc + e["n"])).withColumn("W", F.when(F.col("problem").isNull(), total(lambda e: e["w"])))
    r = r.withColumn("mean", F.try_divide(total(lambda e: e["w"] * e["m"]), F.col("W")))
    r = r.withColumn("between", total(lambda e: e["w"] * (e["m"] - F.col("mean")) ** 2)).withColumn("lam", F.when(F.col("problem").isNull(), total(lambda e: F.try_divide((1 - F.try_divide(e["w"], F.col("W"))) ** 2, e["n"] - 1))))
    k = float(len(levels))
    return r.select(F.lit(len(levels)).cast("long").alias("k"), "n", (F.col("between") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("lam"))).alias("statistic"), F.lit(k - 1).alias("df1"), F.try_divide(F.lit((k * k - 1) / 3), F.col("lam")).alias("df2"), F.sqrt(F.try_divide(F.col("between"), F.col("n"))).alias("effect_size"), "outside", "problem")


def welch_contrast(df: DataFrame, group: str, y: str, weights: dict) -> DataFrame:
    """Sum of weighted means: estimate, se, df, statistic, problem (a level without two values, or no variance at all); the weights must add up to zero."""
    if abs(sum(weights.values())) > 1e-9:
        raise ValueError("contrast weights must add up to 0")
    g = F.col(group)
    aggs = [c for i, lvl in enumerate(weights) for c in _arm(_num(y), g == F.lit(lvl), str(i))]
    r = df.where(g.isin(*weights)).agg(*aggs)
    few = F.coalesce(*[F.when(F.col(f"n_{i}") < 2, F.lit(f"level {lvl} has fewer than two values")) for i, lvl in enumerate(weights)])
    terms = [(w, F.col(f"mean_{i}"), F.col(f"var_{i}"), F.col(f"n_{i}")) for i, w in enumerate(weights.values())]
    est = sum((m * w for w, m, _, _ in terms), F.lit(0.0))
    var = sum((F.try_divide(v * (w * w), n) for w, _, v, n in terms), F.lit(0.0))
    low = sum((F.try_divide(F.try_divide(v * (w * w), n) ** 2, n - 1) for w, _, v, n in terms), F.lit(0.0))
    r = r.withColumn("problem", few).select("problem", est.alias("estimate"), var.alias("var"), low.alias("low"))
    r = r.withColumn("problem", F.coalesce("problem", F.when(~F.coalesce(F.col("var") > 0, F.lit(False)), "no variance")))
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    return r.select(ok(F.col("estimate")).alias("estimate"), ok(F.sqrt("var")).alias("se"), ok(F.try_divide(F.col("var") * F.col("var"), F.col("low"))).alias("df"), ok(F.try_divide(F.col("estimate"), F.sqrt("var"))).alias("statistic"), "problem")


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Uncorrected Pearson over the observed levels: n, rows, cols, statistic, df, effect_size (Cramer V), least_expected, problem (fewer than two levels on a side)."""
    cells = df.where(f"`{row}` is not null and `{col}` is not null").groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("r").agg(F.sum("o").alias("ro"))
    cols = cells.groupBy("c").agg(F.sum("o").alias("co"))
    n = cells.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n"), F.countDistinct("r").alias("nr"), F.countDistinct("c").alias("nc"))
    # sum over all cells of (o-e)^2/e = n * (sum over observed cells of o^2/(row*col) - 1): empty cells need no rows
    s = cells.join(rows, "r").join(cols, "c").agg(F.sum(F.col("o") * F.col("o") / (F.col("ro") * F.col("co"))).alias("q"))
    # single rows become columns of the one row, so nothing is joined
    one = s.withColumn("_t", n.select(F.struct("*")).scalar()).withColumn("r0", rows.agg(F.min("ro")).scalar()).withColumn("c0", cols.agg(F.min("co")).scalar()).select("q", "_t.*", "r0", "c0")
    one = one.withColumn("problem", F.when((F.col("nr") < 2) | (F.col("nc") < 2), "fewer than two levels"))
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    k = F.least("nr", "nc") - 1
    stat = F.col("n") * (F.col("q") - 1)
    return one.select("n", F.col("nr").alias("rows"), F.col("nc").alias("cols"), ok(stat).alias("statistic"), ok(((F.col("nr") - 1) * (F.col("nc") - 1)).cast("double")).alias("df"), ok(F.sqrt(F.try_divide(stat, F.col("n") * k))).alias("effect_size"), F.try_divide(F.col("r0") * F.col("c0"), F.col("n")).alias("least_expected"), "problem")


def _two_levels(df: DataFrame, c: str) -> list | None:
    seen = [r[0] for r in df.select(c).distinct().limit(3).collect()]
    return sorted(seen) if len(seen) == 2 else None


def fisher(df: DataFrame, row: str, col: str, row_levels: list | None = None, col_levels: list | None = None, level: float = 0.95) -> DataFrame:
    """The 2 x 2 table of two row and two column levels: a, b, c, d, estimate (odds ratio), ci_low, ci_high (Woolf), problem.

    Rows of other levels than the declared ones don't count; a declared level that no complete row has is a problem. Without a
    declaration the data must have exactly two. 0.5 is added to each cell only if one is empty.
    """
    both = df.where(f"`{row}` is not null and `{col}` is not null")
    rl, cl = row_levels or _two_levels(both, row), col_levels or _two_levels(both, col)
    if not rl or not cl or len(rl) != 2 or len(cl) != 2:
        return df.sparkSession.createDataFrame([(None,) * 7 + ("not a 2 x 2 table",)], "a bigint, b bigint, c bigint, d bigint, estimate double, ci_low double, ci_high double, problem string")
    x, y = [F.col(row) == F.lit(v) for v in rl], [F.col(col) == F.lit(v) for v in cl]
    cnt = lambda p: F.count(F.when(p, 1))
    r = both.agg(*[cnt(x[i] & y[j]).alias("abcd"[2 * i + j]) for i in (0, 1) for j in (0, 1)], *[cnt(p).alias(f"_{n}") for n, p in enumerate([*x, *y])])
    r = r.withColumn("problem", F.coalesce(*[F.when(F.col(f"_{n}") == 0, F.lit(f"level {v} is absent")) for n, v in enumerate([*rl, *cl])]))
    add = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    a, b, c, d = [F.col(k) + add for k in "abcd"]
    log = F.log(a * d / (b * c))
    half = F.lit(dist.norm_ppf(0.5 + level / 2)) * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    ok = lambda v: F.when(F.col("problem").isNull(), v)
    return r.select("a", "b", "c", "d", ok(a * d / (b * c)).alias("estimate"), ok(F.exp(log - half)).alias("ci_low"), ok(F.exp(log + half)).alias("ci_high"), "problem")


def _gram(df: DataFrame, xs: list[Column], y: Column, w: Column | None = None, z: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'WX and X'Wz in one pass; the result is k x k, whatever the rows."""
    k, w = len(xs), F.lit(1.0) if w is None else w
    z = y if z is None else z
    aggs = [F.sum(w * xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * xs[i] * z).alias(f"b{i}") for i in range(k)] + [F.count(F.lit(1)).alias("n")]
    r = df.agg(*aggs).collect()[0]
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g, np.array([r[f"b{i}"] or 0.0 for i in range(k)]), r["n"]


def ols(df: DataFrame, y: str, xs: list[str], robust: str = "HC3") -> DataFrame:
    """term, estimate, se, statistic, n, r2: least squares with intercept by two passes over the rows.

    The first pass gives the Gram matrix (k x k), the second the residual sums, with each row's leverage
    from the inverse. Robust errors use the normal distribution, nonrobust ones t.
    """
    spark = df.sparkSession
    data = df.select(_num(y).alias("y"), *[_num(x).alias(f"x{i}") for i, x in enumerate(xs, 1)]).dropna()
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, len(xs) + 1)]]
    g, b, n = _gram(data, cols, F.col("y"))
    k = len(cols)
    if n <= k or np.linalg.matrix_rank(g) < k:
        raise ValueError("the design has not full rank")
    inv = np.linalg.inv(g)
    beta = inv @ b
    fit = sum((c * float(v) for c, v in zip(cols, beta)), F.lit(0.0))
    e = F.col("y") - fit
    lev = sum((cols[i] * cols[j] * float(inv[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    u = {"HC3": (e / (1 - lev)) ** 2, "HC0": e * e, "nonrobust": F.lit(0.0)}[robust]
    r = data.withColumn("_u", u).withColumn("_e", e).withColumn("_h", lev).agg(*[F.sum(F.col("_u") * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], F.sum(F.col("_e") ** 2).alias("rss"), F.var_pop("y").alias("vy"), F.max("_h").alias("max_leverage"), F.max(F.col("_e") ** 2 * F.col("_h") / (1 - F.col("_h")) ** 2).alias("cook")).collect()[0]
    sigma2 = r["rss"] / (n - k)
    if robust == "nonrobust":
        cov = inv * sigma2
    else:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        cov = inv @ m @ inv
    se = np.sqrt(np.diag(cov))
    r2 = 1 - r["rss"] / (r["vy"] * n) if r["vy"] else None
    rows = [(t, float(beta[i]), float(se[i]), float(beta[i] / se[i]), n, r2, float(n - k), r["max_leverage"], r["cook"] / (k * sigma2) if sigma2 else None) for i, t in enumerate(["intercept", *xs])]
    return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, n long, r2 double, df double, max_leverage double, max_cook double")


def glm(df: DataFrame, y: str, xs: list[str], family: str, offset: str | None = None, robust: str = "HC0", rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """Logistic ("binomial", y in 0/1) or Poisson regression by reweighted least squares: term, estimate, se, statistic, ratio (odds or rate), n, deviance, pearson_dispersion.

    Each round is one pass to a k x k matrix. Separation (fitted probabilities at 0 or 1) and rounds without
    convergence are errors.
    """
    spark = df.sparkSession
    data = df.select(_num(y).alias("y"), *[_num(x).alias(f"x{i}") for i, x in enumerate(xs, 1)], (_num(offset) if offset else F.lit(0.0)).alias("o")).dropna()
    # every round reads the narrow matrix, not what it was made from
    data = Scratch(spark, "glm").write(data, "matrix")
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, len(xs) + 1)]]
    k = len(cols)
    m0 = data.agg(F.avg("y").alias("m"), F.avg(F.exp("o")).alias("eo"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()[0]
    if m0.m is None or m0.lo == m0.hi and family == "binomial" or m0.lo < 0:
        raise ValueError("the outcome doesn't fit the family")
    beta = np.zeros(k)
    beta[0] = math.log(m0.m / (1 - m0.m)) if family == "binomial" else math.log(m0.m / m0.eo)
    last = None
    for _ in range(rounds):
        eta = sum((c * float(v) for c, v in zip(cols, beta)), F.col("o"))
        mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
        w = F.greatest(mu * (1 - mu), F.lit(1e-12)) if family == "binomial" else F.greatest(mu, F.lit(1e-12))
        ready = data.withColumn("_eta", eta).withColumn("_mu", mu).withColumn("_w", w)
        g, b, n = _gram(ready, cols, F.col("y"), F.col("_w"), F.col("_eta") - F.col("o") + (F.col("y") - F.col("_mu")) / F.col("_w"))
        new = np.linalg.solve(g, b)
        if family == "binomial" and np.abs(new).max() > 1e4:
            raise ValueError("the outcome is separated")
        step, beta = np.abs(new - beta).max(), new
        if step < tol * (1 + np.abs(beta).max()):
            last = step
            break
    if last is None:
        raise ValueError("no convergence")
    eta = sum((c * float(v) for c, v in zip(cols, beta)), F.col("o"))
    mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
    v = F.col("_mu") * (1 - F.col("_mu")) if family == "binomial" else F.col("_mu")
    e = F.col("y") - F.col("_mu")
    dev = -2 * F.log(F.when(F.col("y") == 1, F.col("_mu")).otherwise(1 - F.col("_mu"))) if family == "binomial" else 2 * (F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("_mu"))).otherwise(0.0) - e)
    r = data.withColumn("_mu", mu).agg(*[F.sum(e * e * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], F.sum(dev).alias("dev"), F.sum(e * e / v).alias("pear")).collect()[0]
    inv = np.linalg.inv(g)
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
    se = np.sqrt(np.diag(inv @ meat @ inv if robust == "HC0" else inv))
    rows = [(t, float(beta[i]), float(se[i]), float(beta[i] / se[i]), float(math.exp(min(700, beta[i]))), n, float(r["dev"]), float(r["pear"] / (n - k))) for i, t in enumerate(["intercept", *xs])]
    return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, ratio double, n long, deviance double, pearson_dispersion double")


def adjust(df: DataFrame, family: list[str], p: str, ident: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Adds p_bonferroni, p_holm and p_bh within each family; a null p stays null and doesn't count.

    Ranks and running bounds come from range partitions, so a family of any size is no single task.
    """
    scratch = scratch or Scratch(df.sparkSession, "adjust")
    known = df.where(F.col(p).isNotNull()).withColumn("_one", F.lit(1).cast("long"))
    m = df.where(F.col(p).isNotNull()).groupBy(*family).agg(F.count(F.lit(1)).alias("_m"))
    ranked = skew_join(with_running(known, family, [p, *ident], {"_i": ("_one", "sum", True)}, scratch, "ranked"), m, family)
    one = F.lit(1.0)
    ranked = ranked.withColumn("p_bonferroni", F.least(one, F.col(p) * F.col("_m"))).withColumn("_h", F.least(one, (F.col("_m") - F.col("_i") + 1) * F.col(p))).withColumn("_b", F.least(one, F.col(p) * F.col("_m") / F.col("_i"))).withColumn("_down", -F.col("_i"))
    held = scratch.write(with_running(ranked, family, ["_i"], {"p_holm": ("_h", "max", True)}, scratch, "holm"), "held")
    out = with_running(held, family, ["_down"], {"p_bh": ("_b", "min", True)}, scratch, "bh").drop("_one", "_i", "_m", "_h", "_b", "_down")
    none = F.lit(None).cast("double")
    rest = df.where(F.col(p).isNull()).withColumn("p_bonferroni", none).withColumn("p_holm", none).withColumn("p_bh", none)
    return out.unionByName(rest)


@F.pandas_udf(T.StructType([T.StructField("p_value", T.DoubleType()), T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())]))
def _t_tails(est: pd.Series, se: pd.Series, df: pd.Series, alternative: pd.Series, level: pd.Series) -> pd.DataFrame:
    rows = []
    for e, s, d, alt, lv in zip(est, se, df, alternative, level):
        if any(x is None or (isinstance(x, float) and math.isnan(x)) for x in (e, s, d)) or s <= 0:
            rows.append((None, None, None))
            continue
        t = e / s
        p = dist.t_two_sided(t, d) if alt == "two-sided" else 1 - dist.t_cdf(t, d) if alt == "greater" else dist.t_cdf(t, d)
        h = dist.t_ppf(0.5 + lv / 2, d) * s
        rows.append((p, e - h, e + h))
    return pd.DataFrame(rows, columns=["p_value", "ci_low", "ci_high"])


def t_inference(r: DataFrame, level: float = 0.95, alternative: str = "two-sided") -> DataFrame:
    """Adds p_value, ci_low and ci_high from estimate, se and df."""
    t = _t_tails("estimate", "se", "df", F.lit(alternative), F.lit(level))
    return r.withColumn("_t", t).select(*r.columns, "_t.p_value", "_t.ci_low", "_t.ci_high")


def bootstrap_mean(df: DataFrame, y: str, resamples: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """estimate, ci_low, ci_high, valid of a mean: Poisson bootstrap in one pass, each row drawing its weights for all resamples.

    Partial sums are ``resamples`` numbers a task. Draws are seeded by block, so a run repeats itself on the same
    partitions of the same rows, but not across other partitionings.
    """
    v = df.select(_num(y).alias("v")).where("v is not null").withColumn("h", F.xxhash64(F.monotonically_increasing_id(), F.col("v")))

    def each(batches):
        total = np.zeros(resamples)
        weight = np.zeros(resamples)
        for b in batches:
            rows = b["v"].to_numpy()
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                w = np.random.default_rng([seed, int(b["h"].iloc[i]) & 0x7FFFFFFF]).poisson(1.0, (len(part), resamples))
                total += part @ w
                weight += w.sum(axis=0)
        yield pd.DataFrame({"r": np.arange(resamples), "t": total, "w": weight})

    sums = v.mapInPandas(each, "r int, t double, w double").groupBy("r").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).where("w > 0").select((F.col("t") / F.col("w")).alias("m"))
    a = (1 - level) / 2
    boot = sums.agg(F.percentile("m", a).alias("ci_low"), F.percentile("m", 1 - a).alias("ci_high"), F.count("m").alias("valid"))
    return v.agg(F.avg("v").alias("estimate")).withColumn("_b", boot.select(F.struct("*")).scalar()).select("estimate", "_b.*")


def bootstrap_moments(df: DataFrame, x: str, y: str, statistic: str, resamples: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """estimate, ci_low, ci_high, valid of a correlation or a paired mean difference (y - x), rows drawn as pairs.

    Poisson bootstrap in one pass: six weighted sums a resample and task. Resamples without a finite value don't count;
    with fewer valid ones than max(100, resamples / 20) the interval is null.
    """
    if statistic not in ("correlation", "paired_difference"):
        raise ValueError(f"no such statistic: {statistic}")
    v = df.select(_num(x).alias("x"), _num(y).alias("y")).dropna().withColumn("h", F.xxhash64(F.monotonically_increasing_id(), "x", "y"))

    def each(batches):
        sums = np.zeros((6, resamples))
        for b in batches:
            a, c, h = b["x"].to_numpy(), b["y"].to_numpy(), b["h"].to_numpy()
            for i in range(0, len(a), 4096):
                w = np.random.default_rng([seed, int(h[i]) & 0x7FFFFFFF]).poisson(1.0, (len(a[i : i + 4096]), resamples))
                p, q = a[i : i + 4096], c[i : i + 4096]
                for n, col in enumerate((np.ones(len(p)), p, q, p * p, q * q, p * q)):
                    sums[n] += col @ w
        yield pd.DataFrame({"r": np.arange(resamples)} | {f"s{n}": sums[n] for n in range(6)})

    s = v.mapInPandas(each, "r int, " + ", ".join(f"s{n} double" for n in range(6))).groupBy("r").agg(*[F.sum(f"s{n}").alias(f"s{n}") for n in range(6)]).where("s0 > 0")
    n, sx, sy, sxx, syy, sxy = [F.col(f"s{i}") for i in range(6)]
    cov, vx, vy = sxy / n - sx * sy / (n * n), sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
    stat = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)) if statistic == "correlation" else (sy - sx) / n
    a = (1 - level) / 2
    boot = s.select(stat.alias("m")).where("m is not null and not isnan(m)").agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi"), F.count("m").alias("valid"))
    enough = F.col("valid") >= max(100, resamples // 20)
    own = v.agg((F.corr("x", "y") if statistic == "correlation" else F.avg(F.col("y") - F.col("x"))).alias("estimate"))
    return own.withColumn("_b", boot.select(F.struct("*")).scalar()).select("estimate", "_b.*").select("estimate", F.when(enough, F.col("lo")).alias("ci_low"), F.when(enough, F.col("hi")).alias("ci_high"), "valid")


def model_cohort(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that a model over these columns uses: complete and numeric in all of them."""
    return df.where(reduce(lambda a, b: a & b, [_num(c).isNotNull() for c in columns]))
