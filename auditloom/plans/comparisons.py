"""Tabular analysis over the star-schema tables: profiles, cleaning, comparisons and multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.typed import json_kind
from auditloom.operators import clean, stats
from auditloom.plans.tables import table
from auditloom.scratch import Scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of addition in the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- profiles and cleaning

_PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_fraction, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _PROFILED))
def profile_columns(s: SparkSession, d: str) -> DataFrame:
    return rounded(clean.profile_columns(table(s, d, "lineitem")))


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, round(avg({c}), 4) AS mean, CAST(max({c}) AS DOUBLE) AS max, round(stddev_samp({c}), 4) AS sd, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem" for c in _NUMBERS))
def profile_numeric(s: SparkSession, d: str) -> DataFrame:
    return rounded(clean.profile_numbers(table(s, d, "lineitem"), _NUMBERS), 4)


@query("profile_topk", """SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS BIGINT) AS rank FROM
  (SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, value LIMIT 10""")
def profile_topk(s: SparkSession, d: str) -> DataFrame:
    return clean.top_values(table(s, d, "lineitem"), "l_suppkey", 10)


@query("exact_duplicates", """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM
  (SELECT *, count(*) AS n FROM documents GROUP BY ALL)""")
def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return clean.duplicate_rows(docs := table(s, d, "documents"), docs.columns)


@query("clean_reject_counts", """SELECT coalesce(CASE WHEN l_shipdate IS NULL THEN 'required' WHEN l_quantity < 5 OR l_quantity > 45 THEN 'range' WHEN l_returnflag NOT IN ('A', 'N') THEN 'level' END, 'kept') AS rule_id,
  count(*) AS rows, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1""")
def clean_reject_counts(s: SparkSession, d: str) -> DataFrame:
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    ruled = clean.first_rule(table(s, d, "lineitem"), [("required", F.col("l_shipdate").isNull()), ("range", (q < 5) | (q > 45)), ("level", flag.isNotNull() & ~flag.isin("A", "N"))])
    return ruled.groupBy(F.coalesce("rule_id", F.lit("kept")).alias("rule_id")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("replicate_aggregate", """SELECT l_orderkey, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, min(l_linestatus) AS l_linestatus,
  array_to_string(list_sort(list(CAST(l_linenumber AS VARCHAR))), ';') AS source_ids, count(*) AS replicate_n FROM lineitem GROUP BY 1""")
def replicate_aggregate(s: SparkSession, d: str) -> DataFrame:
    return rounded(clean.replicates(table(s, d, "lineitem"), ["l_orderkey"], ["l_quantity", "l_discount"], ["l_linestatus"], "l_linenumber"))


@query("replicate_conflicts", "SELECT l_orderkey, count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) AS levels FROM lineitem GROUP BY 1 HAVING levels > 1")
def replicate_conflicts(s: SparkSession, d: str) -> DataFrame:
    return clean.conflicting_groups(table(s, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("pair_uniqueness", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def pair_uniqueness(s: SparkSession, d: str) -> DataFrame:
    return clean.repeated_cells(table(s, d, "events"), ["user_id", "event_type"])


@query("typed_levels", """SELECT kind, count(*) AS n, count(DISTINCT v) AS levels FROM (SELECT CASE json_type(json_extract(props, '$.k')) WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'missing' ELSE CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing' ELSE 'num' END END AS kind,
  CAST(json_extract(props, '$.k') AS VARCHAR) AS v FROM events) GROUP BY kind""")
def typed_levels(s: SparkSession, d: str) -> DataFrame:
    # the value as JSON text, with its type
    text = F.to_json(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    return table(s, d, "events").select(json_kind(text).alias("kind"), text.alias("v")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("levels"))


@query("sensitivity_filter", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE NOT (coalesce(o_orderpriority = '5-LOW', false) OR coalesce(o_totalprice > 400000, false)) AND NOT coalesce(o_orderstatus IN ('P'), false) GROUP BY 1")
def sensitivity_filter(s: SparkSession, d: str) -> DataFrame:
    kept = clean.exclude_any(table(s, d, "orders"), [("o_orderpriority", "eq", "5-LOW"), ("o_totalprice", "gt", 400000), ("o_orderstatus", "in", ["P"])])
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---- comparisons

_WELCH = """r AS (SELECT count(*) FILTER (g = '{a}') AS n_a, avg(y) FILTER (g = '{a}') AS mean_a, var_samp(y) FILTER (g = '{a}') AS var_a,
    count(*) FILTER (g = '{b}') AS n_b, avg(y) FILTER (g = '{b}') AS mean_b, var_samp(y) FILTER (g = '{b}') AS var_b FROM (SELECT {g} AS g, {y} AS y FROM {t})),
  w AS (SELECT *, mean_b - mean_a AS estimate, sqrt(var_a / n_a + var_b / n_b) AS se,
    (var_a / n_a + var_b / n_b) ** 2 / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)) AS df,
    sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS sp FROM r)"""
_W_OUT = ["n_a", "n_b", "mean_a", "mean_b", "estimate", "se", "df", "statistic", "effect_size"]


def _welch_orders(s: SparkSession, d: str) -> DataFrame:
    return stats.welch(table(s, d, "orders"), "o_orderstatus", "o_totalprice", "F", "O")


@query("welch_t", "WITH " + _WELCH.format(a="F", b="O", g="o_orderstatus", y="o_totalprice", t="orders") + """ SELECT n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(estimate, 4) AS estimate, round(se, 4) AS se,
  round(df, 4) AS df, round(estimate / se, 4) AS statistic, round(estimate / sp * (1 - 3.0 / (4 * (n_a + n_b - 2) - 1)), 4) AS effect_size FROM w""")
def welch_t(s: SparkSession, d: str) -> DataFrame:
    return rounded(_welch_orders(s, d).select(*_W_OUT), 4)


@query("welch_t_inference")
def welch_t_inference(s: SparkSession, d: str) -> DataFrame:
    return stats.t_inference(_welch_orders(s, d))


@query("tost_welch", "WITH " + _WELCH.format(a="BUILDING", b="MACHINERY", g="c_mktsegment", y="c_acctbal", t="customer") + """ SELECT n_a, n_b, round(estimate, 4) AS estimate, round(se, 4) AS se, round((estimate + 500) / se, 4) AS statistic_low, round((estimate - 500) / se, 4) AS statistic_high,
  round(least((estimate + 500) / se, -(estimate - 500) / se), 4) AS statistic FROM w""")
def tost_welch(s: SparkSession, d: str) -> DataFrame:
    r = stats.tost(stats.welch(table(s, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY"), -500.0, 500.0)
    return rounded(r.select("n_a", "n_b", "estimate", "se", "statistic_low", "statistic_high", "statistic"), 4)


def _user_means(s: SparkSession, d: str) -> DataFrame:
    """One value per user and event type."""
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"))


_PAIRS = """u AS (SELECT user_id, event_type, round(avg(value), 6) AS value FROM events GROUP BY ALL),
  p AS (SELECT a.user_id, a.value AS a, b.value AS b, b.value - a.value AS d FROM u a JOIN u b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND b.event_type = 'click' AND a.value IS NOT NULL AND b.value IS NOT NULL)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return stats.paired_values(_user_means(s, d), ["user_id"], "event_type", "value", "view", "click")


@query("paired_t", f"""WITH {_PAIRS} SELECT count(*) AS n, round(avg(d), 5) AS estimate, round(stddev_samp(d), 5) AS sd, round(stddev_samp(d) / sqrt(count(*)), 5) AS se, CAST(count(*) - 1 AS DOUBLE) AS df,
  round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) AS statistic, round(avg(d) / stddev_samp(d), 5) AS effect_size, round(skewness(d), 5) AS skewness FROM p""")
def paired_t(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.paired(_pairs(s, d)), 5)


@query("tost_paired", f"""WITH {_PAIRS}, m AS (SELECT count(*) AS n, avg(d) AS estimate, stddev_samp(d) / sqrt(count(*)) AS se FROM p)
  SELECT n, round(estimate, 5) AS estimate, round((estimate + 5) / se, 5) AS statistic_low, round((estimate - 5) / se, 5) AS statistic_high, round(least((estimate + 5) / se, -(estimate - 5) / se), 5) AS statistic FROM m""")
def tost_paired(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.tost(stats.paired(_pairs(s, d)), -5.0, 5.0).select("n", "estimate", "statistic_low", "statistic_high", "statistic"), 5)


@query("mann_whitney_u", """WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS y FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')),
  k AS (SELECT g, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r FROM v),
  t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY y)),
  m AS (SELECT count(*) FILTER (g = 'BUILDING') AS n_a, count(*) FILTER (g = 'FURNITURE') AS n_b, CAST(sum(r) FILTER (g = 'FURNITURE') AS DOUBLE) AS rb FROM k),
  u AS (SELECT n_a, n_b, rb - n_b * (n_b + 1) / 2.0 AS u, ties FROM m, t)
  SELECT n_a, n_b, ties, round(u, 4) AS u, round(2 * u / (n_a * n_b) - 1, 6) AS effect_size,
    round((abs(u - n_a * n_b / 2.0) - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) * sign(u - n_a * n_b / 2.0), 6) AS z FROM u""")
def mann_whitney_u(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mann_whitney(table(s, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "FURNITURE", Scratch(s, "mw")))


@query("wilcoxon_w", f"""WITH {_PAIRS}, k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM p WHERE d <> 0)
  SELECT count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0), 4)::DOUBLE AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 4)::DOUBLE AS w_minus, round(least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)), 4)::DOUBLE AS w,
    round((coalesce(sum(r) FILTER (d > 0), 0) - coalesce(sum(r) FILTER (d < 0), 0)) / sum(r), 6)::DOUBLE AS effect_size, round(sum(CAST(t AS DOUBLE) * t - 1), 4) AS ties FROM k""")
def wilcoxon_w(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.wilcoxon(_pairs(s, d), Scratch(s, "wx")).select("n", "w_plus", "w_minus", "w", "effect_size", "ties"))


@query("pearson_r", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS estimate, round(atanh(corr(l_quantity, l_extendedprice)), 6) AS fisher_z, round(1 / sqrt(count(*) - 3), 6) AS se_z FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def pearson_r(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.pearson(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("spearman_rho", """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
  SELECT count(*) AS n, round(corr(a, b), 6) AS estimate FROM k""")
def spearman_rho(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", Scratch(s, "rho")))


@query("ols_simple_hc3", """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n, sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) ** 2) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem),
  e AS (SELECT l_quantity - mx AS xc, mx, sxx, n, b0, b1, r2, (l_extendedprice - b0 - b1 * l_quantity) / (1 - (1.0 / n + (l_quantity - mx) ** 2 / sxx)) AS u FROM lineitem, m),
  c AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(r2) AS r2, any_value(n) AS n, sqrt(sum(u * u * xc * xc)) / any_value(sxx) AS se1, sqrt(sum((u * (1.0 / n - mx * xc / sxx)) ** 2)) AS se0 FROM e)
  SELECT 'intercept' AS term, round(b0, 3) AS estimate, round(se0, 3) AS se, round(b0 / se0, 3) AS statistic, n, round(r2, 3) AS r2 FROM c UNION ALL SELECT 'l_quantity', round(b1, 3), round(se1, 3), round(b1 / se1, 3), n, round(r2, 3) FROM c""")
def ols_simple_hc3(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ols(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", "estimate", "se", "statistic", "n", "r2"), 3)


@query("ancova_fwl", """WITH o AS (SELECT o_totalprice AS y, CAST(o_orderstatus = 'O' AS INT) AS g, year(o_orderdate) - 1995.0 AS x FROM orders WHERE o_orderstatus IN ('F', 'O')),
  r AS (SELECT *, g - (SELECT regr_intercept(g, x) FROM o) - (SELECT regr_slope(g, x) FROM o) * x AS rg, y - (SELECT regr_intercept(y, x) FROM o) - (SELECT regr_slope(y, x) FROM o) * x AS ry FROM o)
  SELECT count(*) AS n, round(sum(rg * ry) / sum(rg * rg), 3) AS estimate FROM r""")
def ancova_fwl(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "O").cast("double").alias("g"), (F.year("o_orderdate") - 1995.0).alias("x"))
    return rounded(stats.ols(o, "y", ["g", "x"]).where("term = 'g'").select("n", "estimate"), 3)


@query("logit_irls")
def logit_irls(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select((F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"), (F.year("o_orderdate") - 1995.0).alias("year"))
    return stats.glm(o, "y", ["price", "year"], "binomial")


@query("poisson_glm")
def poisson_glm(s: SparkSession, d: str) -> DataFrame:
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("y"), F.avg("l_quantity").alias("quantity"), F.log(F.sum("l_quantity")).alias("exposure"))
    return stats.glm(per, "y", ["quantity"], "poisson", "exposure")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("welch_anova", """WITH p AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, count(*) / var_samp(o_totalprice) AS w FROM orders GROUP BY 1),
  t AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS W_all, sum(w * m) / sum(w) AS mw FROM p),
  s AS (SELECT any_value(k) AS k, any_value(t.n) AS n, sum(w * (m - mw) ** 2) AS b, sum((1 - w / W_all) ** 2 / (p.n - 1)) AS lam FROM p, t)
  SELECT k, CAST(n AS BIGINT) AS n, round(b / (k - 1) / (1 + 2.0 * (k - 2) / (k * k - 1) * lam), 4) AS statistic, CAST(k - 1 AS DOUBLE) AS df1, round((k * k - 1) / (3 * lam), 3) AS df2, round(sqrt(b / n), 5) AS effect_size FROM s""")
def welch_anova(s: SparkSession, d: str) -> DataFrame:
    r = stats.welch_anova(table(s, d, "orders"), "o_orderpriority", "o_totalprice", _PRIORITIES)
    return r.select("k", "n", F.round("statistic", 4).alias("statistic"), "df1", F.round("df2", 3).alias("df2"), F.round("effect_size", 5).alias("effect_size"))


@query("welch_contrast", """WITH p AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '3-MEDIUM' THEN -0.5 WHEN '5-LOW' THEN -0.5 END::DOUBLE AS c FROM orders GROUP BY 1),
  s AS (SELECT sum(c * m) AS est, sum(c * c * v / n) AS q, sum((c * c * v / n) ** 2 / (n - 1)) AS l FROM p WHERE c IS NOT NULL)
  SELECT round(est, 4) AS estimate, round(sqrt(q), 4) AS se, round(q * q / l, 3) AS df, round(est / sqrt(q), 5) AS statistic FROM s""")
def welch_contrast(s: SparkSession, d: str) -> DataFrame:
    r = stats.welch_contrast(table(s, d, "orders"), "o_orderpriority", "o_totalprice", {"1-URGENT": 1.0, "3-MEDIUM": -0.5, "5-LOW": -0.5})
    return r.select(F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), F.round("df", 3).alias("df"), F.round("statistic", 5).alias("statistic"))


@query("chi_square_v", """WITH c AS (SELECT c_mktsegment AS r, n_regionkey AS c, count(*) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
  rs AS (SELECT r, sum(o) AS ro FROM c GROUP BY r), cs AS (SELECT c, sum(o) AS co FROM c GROUP BY c), t AS (SELECT sum(o) AS n FROM c),
  x AS (SELECT rs.r, cs.c, ro * co / n::DOUBLE AS e, coalesce(o, 0) AS o FROM rs CROSS JOIN cs CROSS JOIN t LEFT JOIN c ON c.r = rs.r AND c.c = cs.c)
  SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, (SELECT count(*) FROM rs) AS rows, (SELECT count(*) FROM cs) AS cols, round(sum((o - e) ** 2 / e), 5) AS statistic, CAST(((SELECT count(*) FROM rs) - 1) * ((SELECT count(*) FROM cs) - 1) AS DOUBLE) AS df,
    round(sqrt(sum((o - e) ** 2 / e) / ((SELECT n FROM t) * (least((SELECT count(*) FROM rs), (SELECT count(*) FROM cs)) - 1))), 5) AS effect_size, round(min(e), 5) AS least_expected FROM x""")
def chi_square_v(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    return rounded(stats.chi_square(table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_mktsegment", "n_regionkey").drop("problem"), 5)


@query("fisher_or", """WITH t AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS b, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS d FROM lineitem),
  x AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS k FROM t)
  SELECT a, b, c, d, round((a + k) * (d + k) / ((b + k) * (c + k)), 5) AS estimate, round(exp(ln((a + k) * (d + k) / ((b + k) * (c + k))) - 1.959963984540054 * sqrt(1 / (a + k) + 1 / (b + k) + 1 / (c + k) + 1 / (d + k))), 5) AS ci_low,
    round(exp(ln((a + k) * (d + k) / ((b + k) * (c + k))) + 1.959963984540054 * sqrt(1 / (a + k) + 1 / (b + k) + 1 / (c + k) + 1 / (d + k))), 5) AS ci_high FROM x""")
def fisher_or(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.fisher(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", ["R", "N"], ["F", "O"]).drop("problem"), 5)


_P = "(CAST((p_partkey * 7919) % 10007 + 1 AS DOUBLE) / 10008)"


@query("adjust_p", f"""WITH b AS (SELECT p_brand, p_partkey, {_P}::DOUBLE AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS i FROM b)
  SELECT p_brand, p_partkey, round(p, 8) AS p, round(least(1.0, p * m), 8)::DOUBLE AS p_bonferroni, round(max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY p_brand ORDER BY i ROWS UNBOUNDED PRECEDING), 8)::DOUBLE AS p_holm,
    round(min(least(1.0, p * m / i)) OVER (PARTITION BY p_brand ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 8)::DOUBLE AS p_bh FROM r""")
def adjust_p(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "part").select("p_brand", "p_partkey", F.expr(_P).cast("double").alias("p"))
    return rounded(stats.adjust(b, ["p_brand"], "p", ["p_partkey"]), 8)


@query("sensitivity_delta", "WITH " + _WELCH.format(a="F", b="O", g="o_orderstatus", y="o_totalprice", t="orders") + ", " + _WELCH.format(a="F", b="O", g="o_orderstatus", y="o_totalprice", t="(SELECT * FROM orders WHERE NOT coalesce(o_orderpriority = '5-LOW', false))").replace("r AS", "r2 AS").replace("FROM r)", "FROM r2)").replace("w AS", "w2 AS") + """
  SELECT round(w.estimate, 4) AS base_estimate, round(w2.estimate, 4) AS estimate, round(w2.estimate - w.estimate, 4) AS delta FROM w, w2""")
def sensitivity_delta(s: SparkSession, d: str) -> DataFrame:
    base = _welch_orders(s, d).select(F.col("estimate").alias("base_estimate"))
    kept = clean.exclude_any(table(s, d, "orders"), [("o_orderpriority", "eq", "5-LOW")])
    other = stats.welch(kept, "o_orderstatus", "o_totalprice", "F", "O").select("estimate")
    return rounded(base.withColumn("estimate", other.scalar()).select("base_estimate", "estimate", (F.col("estimate") - F.col("base_estimate")).alias("delta")), 4)


@query("bootstrap_mean")
def bootstrap_mean(s: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_mean(table(s, d, "customer"), "c_acctbal")


@query("group_summary_lists", "SELECT n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean, array_to_string(list_sort(list(DISTINCT s_name)), ';') AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def group_summary_lists(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("mean"), F.array_join(F.array_sort(F.collect_set("s_name")), ";").alias("names"))


@query("group_quantiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def group_quantiles(s: SparkSession, d: str) -> DataFrame:
    from auditloom.operators.quantiles import quantiles

    return rounded(quantiles(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", {"q1": 0.25, "median": 0.5, "q3": 0.75}), 4)


#: A prespecified plan over the orders: the queries above as one analysis.
ORDERS_PLAN = {
    "analyses": [
        {"id": "price_by_status", "type": "independent_t", "group": "o_orderstatus", "outcome": "o_totalprice", "level_a": "F", "level_b": "O", "family": "price"},
        {"id": "price_equal", "type": "equivalence_tost_independent", "group": "o_orderstatus", "outcome": "o_totalprice", "level_a": "F", "level_b": "P", "low": -20000.0, "high": 20000.0, "family": "price"},
        {"id": "price_ranks", "type": "mann_whitney", "group": "o_orderstatus", "outcome": "o_totalprice", "level_a": "F", "level_b": "O", "family": "price"},
        {"id": "price_by_priority", "type": "welch_anova", "group": "o_orderpriority", "outcome": "o_totalprice", "levels": _PRIORITIES, "family": "price"},
        {"id": "urgent_contrast", "type": "welch_contrast", "group": "o_orderpriority", "outcome": "o_totalprice", "weights": {"1-URGENT": 1.0, "3-MEDIUM": -0.5, "5-LOW": -0.5}},
        {"id": "status_by_priority", "type": "chi_square", "row": "o_orderstatus", "col": "o_orderpriority"},
    ],
    "multiplicity": {"price": "holm"},
    "sensitivity": [{"id": "without_low", "base": "price_by_status", "filters": [["o_orderpriority", "eq", "5-LOW"]], "same_estimand": True}],
}


@query("analysis_plan")
def analysis_plan(s: SparkSession, d: str) -> DataFrame:
    from auditloom.plans import analysis

    return analysis.run(table(s, d, "orders"), ORDERS_PLAN)


@query("median_intervals")
def median_intervals(s: SparkSession, d: str) -> DataFrame:
    from auditloom.operators.quantiles import median_intervals as intervals

    return intervals(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice")
