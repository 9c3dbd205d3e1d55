"""Statistics, typed identity, linkage, audits, sources and streams on small inline cases."""

import difflib
import io
import itertools
import json
import math
import random
import statistics
import subprocess
import sys
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditloom.functions import dist, typed
from auditloom.functions import ledger as L
from auditloom.operators import clean, figures, findings, hashing, linkage, manuscript, ordering, power, quantiles, runs, similar, skew, spans, stats
from auditloom.plans import analysis
from auditloom.scratch import Scratch
from auditloom.sources import readers, sinks
from auditloom.streaming import ledgers as streaming

ROOT = Path(__file__).parent.parent


def rules(df):
    return sorted((r.rule, r.entity_id, r.message) for r in df.collect())


def test_entry_imports_without_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and all(map(callable, q.values()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


# ---- distributed order

def test_previous_and_running_over_partitions(spark):
    rnd = random.Random(4)
    data = [("hot" if i % 3 else f"g{i % 7}", i, rnd.randrange(9)) for i in range(400)] + [(None, i, 1) for i in range(5)]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(5)
    got = {(r.g, r.o): r for r in ordering.with_running(df, ["g"], ["o"], {"s": ("v", "sum", True), "mx": ("v", "max", False), "mn": ("v", "min", True)}, Scratch(spark, "t"), "run").collect()}
    prev = {(r.g, r.o): r.previous for r in ordering.with_previous(df, ["g"], ["o"], "o", Scratch(spark, "t"), "prev").collect()}
    for g in {d[0] for d in data}:
        own = sorted((o, v) for gg, o, v in data if gg == g)
        for i, (o, _) in enumerate(own):
            vs = [v for _, v in own[: i + 1]]
            assert (got[g, o].s, got[g, o].mx, got[g, o].mn) == (sum(vs), max(vs[:-1], default=None), min(vs))
            assert prev[g, o] == (own[i - 1][0] if i else None)


def test_quantiles_and_skew_join(spark):
    rnd = random.Random(5)
    data = [(f"g{i % 3}", rnd.choice([1.0, 2.5, float(i)])) for i in range(101)] + [("g0", None), ("g1", math.nan)]
    got = {r.g: r for r in quantiles.quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"a": 0.25, "b": 0.5, "z": 1.0}).collect()}
    for g in got:
        v = sorted(x for k, x in data if k == g and x is not None and not math.isnan(x))
        assert got[g].b == pytest.approx(statistics.median(v)) and got[g].z == v[-1] and got[g].a == pytest.approx(statistics.quantiles(v, n=4, method="inclusive")[0])
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, x int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, y int")
    assert skew.heavy_keys(left, ["k"]) == [("hot",)]
    assert sorted(map(repr, skew.skew_join(left, right, ["k"], "left").collect())) == sorted(map(repr, left.join(right, "k", "left").collect()))


def test_median_intervals_match_resampling(spark):
    rnd = random.Random(12)
    v = [rnd.expovariate(1) for _ in range(61)]
    df = spark.createDataFrame([("g", x) for x in v] + [("one", 3.0), ("g", None)], "g string, v double")
    got = {r.g: r for r in quantiles.median_intervals(df, ["g"], "v").collect()}
    boot = sorted(statistics.median(rnd.choices(v, k=61)) for _ in range(4000))
    s = sorted(v)
    rank = lambda x: min(range(61), key=lambda i: abs(s[i] - x))
    assert abs(rank(got["g"].ci_low) - rank(boot[100])) <= 1 and abs(rank(got["g"].ci_high) - rank(boot[3899])) <= 1
    assert (got["g"].n, got["one"].ci_low, got["one"].ci_high) == (61, 3.0, 3.0)
    assert quantiles.median_intervals(df.limit(0), ["g"], "v").count() == 0


# ---- distributions and comparisons

def test_distributions():
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9) and dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and dist.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-7)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-9) and dist.hypergeom_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)
    for df, x in itertools.product((1, 2, 3, 10, 200), (-1.5, 0.3, 2.0)):
        assert dist.nct_cdf(x, df, 0.0) == pytest.approx(dist.t_cdf(x, df), abs=1e-7)


ARMS = [("C", v) for v in (9.7, 10.1, 10.4, 9.9, 10.8, 10.2)] + [("T", v) for v in (12.1, 13.0, 11.4, 14.2, 12.7, None, math.nan)]


def test_welch_by_hand(spark):
    r = stats.t_inference(stats.welch(spark.createDataFrame(ARMS, "g string, y double"), "g", "y", "C", "T")).collect()[0]
    a, b = [v for g, v in ARMS if g == "C"], [v for g, v in ARMS if g == "T" and v is not None and not math.isnan(v)]
    qa, qb = statistics.variance(a) / len(a), statistics.variance(b) / len(b)
    df = (qa + qb) ** 2 / (qa**2 / (len(a) - 1) + qb**2 / (len(b) - 1))
    assert (r.n_a, r.n_b) == (6, 5) and r.estimate == pytest.approx(statistics.mean(b) - statistics.mean(a)) and r.df == pytest.approx(df)
    assert r.p_value == pytest.approx(dist.t_two_sided(r.estimate / math.sqrt(qa + qb), df)) and r.ci_low < r.estimate < r.ci_high
    flat = stats.welch(spark.createDataFrame([("C", 1.0), ("C", 1.0), ("T", 1.0), ("T", 1.0)], "g string, y double"), "g", "y", "C", "T").collect()[0]
    assert flat.problem and flat.statistic is None


def test_pairs_ranks_and_missing_ids(spark):
    data = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 2.0), ("b", "y", 4.0), (None, "x", 0.0), (None, "y", 9.0), ("c", "x", 1.0), ("d", "x", 1.0), ("d", "x", 2.0), ("d", "y", 3.0)]
    pairs = stats.paired_values(spark.createDataFrame(data, "p string, c string, y double"), ["p"], "c", "y", "x", "y")
    r = stats.paired(pairs).collect()[0]
    assert (r.n, r.estimate) == (2, 1.5)
    u = stats.mann_whitney(spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 2.0), ("B", 2.0), ("B", 3.0)], "g string, y double"), "g", "y", "A", "B", Scratch(spark, "t")).collect()[0]
    assert u.u == sum((b > a) + (b == a) / 2 for a in (1, 2, 2) for b in (2, 3)) and u.ties == 24.0


def test_regressions_recover_coefficients(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(800):
        x, z = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
        p = 1 / (1 + math.exp(-(0.3 + 1.0 * x)))
        rows.append((x, z, 2 + 3 * x - z, float(rnd.random() < p), float(sum(rnd.random() < math.exp(0.2 + 0.5 * x) / 50 for _ in range(50)))))
    df = spark.createDataFrame(rows, "x double, z double, y double, b double, k double")
    o = {r.term: r for r in stats.ols(df.withColumn("y", F.col("y")), "y", ["x", "z"], "nonrobust").collect()}
    assert o["x"].estimate == pytest.approx(3) and o["z"].estimate == pytest.approx(-1) and o["intercept"].estimate == pytest.approx(2)
    lo = {r.term: r for r in stats.glm(df, "b", ["x"], "binomial").collect()}
    po = {r.term: r for r in stats.glm(df, "k", ["x"], "poisson").collect()}
    assert abs(lo["x"].estimate - 1) < 0.4 and abs(po["x"].estimate - 0.5) < 0.2 and lo["x"].se > 0
    with pytest.raises(ValueError):
        stats.ols(df.withColumn("x2", F.col("x") * 2), "y", ["x", "x2"])
    with pytest.raises(ValueError):
        stats.glm(spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double"), "y", ["x"], "binomial")


def test_adjustments_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04, None]
    got = {r.i: r for r in stats.adjust(spark.createDataFrame([(i, "f", v) for i, v in enumerate(p)], "i int, f string, p double"), ["f"], "p", ["i"]).collect()}
    s = sorted(range(5), key=lambda i: (p[i], i))
    holm, bh, top, low = {}, {}, 0.0, 1.0
    for k, i in enumerate(s):
        top = max(top, min(1, (5 - k) * p[i]))
        holm[i] = top
    for k, i in reversed(list(enumerate(s))):
        low = min(low, min(1, p[i] * 5 / (k + 1)))
        bh[i] = low
    assert all(got[i].p_holm == pytest.approx(holm[i]) and got[i].p_bh == pytest.approx(bh[i]) and got[i].p_bonferroni == pytest.approx(min(1, 5 * p[i])) for i in range(5)) and got[5].p_holm is None


def test_analysis_plan(spark):
    df = spark.createDataFrame([(g, v, "keep" if i % 5 else "review") for i, (g, v) in enumerate(ARMS)], "g string, y double, q string")
    plan = {"analyses": [{"id": "main", "type": "independent_t", "group": "g", "outcome": "y", "level_a": "C", "level_b": "T", "family": "f"}, {"id": "rank", "type": "mann_whitney", "group": "g", "outcome": "y", "level_a": "C", "level_b": "T", "family": "f"}], "multiplicity": {"f": "bonferroni"}, "sensitivity": [{"id": "s1", "base": "main", "filters": [["q", "eq", "review"]], "same_estimand": True}, {"id": "s2", "base": "main", "override": {"type": "mann_whitney"}}]}
    assert analysis.validate(plan) == []
    got = {r.item_id: r for r in analysis.run(df, plan).collect()}
    assert got["main"].p_adjusted == pytest.approx(min(1, 2 * got["main"].p_value)) and got["s1"].delta == pytest.approx(got["s1"].estimate - got["main"].estimate) and got["s2"].delta is None
    bad = {"analyses": [{"id": "a", "type": "welch_contrast", "group": "g", "outcome": "y", "weights": {"x": 1.0, "y": -0.5}}, {"id": "a", "type": "nope"}], "multiplicity": {"z": "magic"}}
    assert len([x for x in analysis.validate(bad) if x[0] == "error"]) == 4
    with pytest.raises(ValueError):
        analysis.run(df, bad)


def test_power():
    assert power.two_proportion_power(0.3, 0.45, 160, 160, 0.05) == pytest.approx(0.794243754499499, abs=1e-12)
    assert power.welch_power(5, 10, 10, 64, 64, 0.05) == pytest.approx(0.8014596, abs=1e-6) and power.paired_power(5, 10, 34, 0.05) == pytest.approx(0.8077775, abs=1e-6)
    r = power.plan_item({"type": "welch_two_group_mean", "solve_for": "sample_size", "mean_difference": 5, "sd_a": "10", "sd_b": 10, "attrition_rate": 0.1}, {})
    assert (r["n"], r["inflated"], r["target_met"]) == (64, 72, True)
    assert power.plan_item({"type": "paired_mean"}, {})["problem"] and power.sparsity(0.01, 0.5, 50, 50) == "poor"


def test_power_plan_validation():
    plan = {"alpha": 2, "planning_items": [{"planning_item_id": "a", "type": "paired_mean", "solve_for": "sample_size", "scenarios": {"scenario_id": "s", "overrides": '{"sd_a": 1, "n_pairs": 4}'}}, {"planning_item_id": "a", "type": "odd"}]}
    assert [m for _, _, m in power.validate_plan(plan)] == ["alpha is out of range", "scenario s may not change sd_a", "the id occurs twice", "unknown type odd"]
    assert power.validate_plan({}) == [("error", "", "the plan has no items")]


def test_bootstrap_and_cohort(spark):
    rnd = random.Random(11)
    data = [(x, 0.8 * x + rnd.gauss(0, 0.5)) for x in (rnd.gauss(0, 1) for _ in range(600))] + [(None, 1.0), (1.0, math.nan)]
    df = spark.createDataFrame(data, "x double, y double")
    c = stats.bootstrap_moments(df, "x", "y", "correlation").collect()[0]
    p = stats.bootstrap_moments(df, "x", "y", "paired_difference").collect()[0]
    m = stats.bootstrap_mean(df, "x").collect()[0]
    assert c.ci_low < c.estimate < c.ci_high and 0.75 < c.estimate < 0.92 and c.ci_high - c.ci_low < 0.1
    assert p.ci_low < p.estimate < p.ci_high and m.ci_low < m.estimate < m.ci_high
    assert stats.bootstrap_moments(df, "x", "y", "correlation", resamples=50).collect()[0].ci_low is None
    assert stats.model_cohort(df, ["x", "y"]).count() == 600


# ---- typed identity and cleaning

def test_typed_levels(spark):
    t = spark.createDataFrame([(x,) for x in ("true", "1", "1.0", '"1"', "false", "null", None, '"true"')], "j string").withColumn("k", typed.variant_key(F.parse_json("j")))
    keys = [r.k for r in t.collect()]
    assert len(set(keys)) == 6 and keys[1] == keys[2] and keys[5] == keys[6] == "missing|"
    assert t.where(typed.key_equals(F.col("k"), "missing|")).count() == 0
    shown = {r.s for r in t.select("k").distinct().select(typed.display_label(F.col("k")).alias("s")).collect()}
    assert {"true [bool]", "true [str]", "1 [str]"} <= shown
    n = spark.createDataFrame([(x,) for x in ("1d", " 1e3 ", "inf", "", "0x1A", "1_0", "-2.5")], "x string").select(typed.number(F.col("x")).alias("n"))
    assert [r.n for r in n.collect()] == [None, 1000.0, math.inf, None, None, None, -2.5]


def test_masks_keep_missing_rows_where_negated(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    n = lambda op, v=None: df.where(clean.sensitivity_mask("x", op, v)).count()
    assert (n("eq", "a"), n("ne", "a"), n("in", ["a"]), n("not_in", ["a"]), n("isna"), n("lt", "b")) == (1, 2, 1, 2, 1, 1)
    assert clean.exclude_any(df, [("x", "eq", "a"), ("x", "isna")]).count() == 1


# ---- text functions

def test_text_functions(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("r")).collect()[0].r
    c = F.col("x")
    assert one(L.norm_doi(c), x=" HTTPS://dx.doi.org/10.1/AB.) ") == "10.1/ab" and one(L.norm_title(c), x="Ångström—“Test”  2") == "a ngstro m test 2"
    assert one(L.numeric_tokens(c), x="from 1,234.5 to +7% (n = -3)") == ["1234.5", "7%", "-3"] and one(L.citation_keys(c), x="see [@a1; also @b-2] and mail@x") == ["a1", "b-2"]
    assert one(L.object_key(c), x="Fig. S2b").asDict() == {"kind": "figure", "number": "S2", "letter": "b"} and one(L.object_key(c), x="none") is None
    assert one(L.word_count(c), x="<!-- gone -->## Head\nIt's `code` a [link](http://x) **bold**") == 5 and one(L.short(c, 5), x="abcdefgh") == "abcd…" and one(L.slug(c), x=" A b/C! ") == "a-b-c"
    assert one(L.clauses(c), x="A rose (and fell); B stayed and C went") == ["A rose (and fell)", "B stayed", "C went"]
    assert one(L.half_resolution(c), x="2024-01-01T00:00:00.25Z") == pytest.approx(0.005) and one(L.iso_time(c), x="2024-01-01T00:00:00") is None
    assert figures.path_ends("M 1 2 l 3 4 H 10 v -1 z") == (1, 2, 1, 2) and figures.path_ends("M0,0 C1,1 2,2 5,6") == (0, 0, 5, 6) and figures.path_ends("L") is None


# ---- linkage

RECORDS = "record_id string, title string, authors string, year string, venue string, doi string, pmid string, pmcid string, arxiv_id string, source string, loaded_at timestamp"


def records(spark, rows):
    base = dict.fromkeys([c.split()[0] for c in RECORDS.split(", ")])
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RECORDS)


def test_exact_groups_and_merge(spark):
    r = records(spark, [{"record_id": "b", "doi": "doi:10.1/X", "title": "T", "year": "2020"}, {"record_id": "a", "doi": "10.1/x", "venue": "V"}, {"record_id": "c", "title": "Only  title!"}, {"record_id": "d", "title": "only title"}, {"record_id": "e"}])
    g = linkage.exact_groups(r)
    assert {x.record_id: x.group_id for x in g.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    m = {x.group_id: x for x in linkage.merge_records(r, g, ["title", "year", "venue", "doi"]).collect()}
    assert (m["a"].title, m["a"].year, m["a"].venue, m["a"].members) == ("T", "2020", "V", 2)


def test_fuzzy_pairs_against_all_pairs(spark):
    rnd = random.Random(8)
    base = ["multi site primary outcome and sensitivity analysis", "a delayed assay plate under canonical conditions", "robust claim ledgers for sampling frames in trials"]
    rows = []
    for i in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(6)):
            t[rnd.randrange(1, len(t))] = rnd.choice("abcdefgh ")
        rows.append({"record_id": f"r{i:02}", "title": "".join(t), "year": rnd.choice(["2020", "2021", "2024", ""]), "doi": rnd.choice([None, None, "10.1/a", "10.1/b"])})
    r = records(spark, rows)
    got = {(x.a, x.b) for x in linkage.fuzzy_pairs(r).collect()}
    reps = {}
    for x in rows:
        k = (" ".join(x["title"].split()), x["year"])
        if k not in reps or x["record_id"] < reps[k]["record_id"]:
            reps[k] = x
    fit = lambda a, b: not a or not b or abs(int(a) - int(b)) <= 1
    want = set()
    for (ka, a), (kb, b) in itertools.combinations(sorted(reps.items(), key=lambda kv: kv[1]["record_id"]), 2):
        if ka[0][0] == kb[0][0] and fit(ka[1], kb[1]) and not (a["doi"] and b["doi"] and a["doi"] != b["doi"]) and difflib.SequenceMatcher(None, ka[0], kb[0]).ratio() >= 0.93:
            want.add((a["record_id"], b["record_id"]))
    assert want and got == want


def test_duplicate_groups_against_all_pairs(spark):
    """Every pair of records by the all-pairs rule, with copies of one title whose identifiers differ, are missing or clash."""
    rnd = random.Random(3)
    base = ["multi site primary outcome and sensitivity analysis", "a delayed assay plate under canonical conditions", "robust claim ledgers for sampling frames in trials"]
    rows = []
    for i in range(45):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 6])):
            t[rnd.randrange(1, len(t))] = rnd.choice("abcdefgh")
        rows.append({"record_id": f"r{i:02}", "title": "".join(t), "year": rnd.choice(["2001", "2010", "2020", "2021", ""]), "doi": rnd.choice([None, f"10.1/{i % 9}"]), "pmid": rnd.choice([None, f"{i % 7}"])})
    rows += [{"record_id": "s1", "title": "Short", "doi": "10.1/q"}, {"record_id": "s2", "title": "short"}, {"record_id": "none"}]
    up = {r["record_id"]: r["record_id"] for r in rows}

    def find(x):
        return x if up[x] == x else find(up[x])

    fit = lambda a, b: not a or not b or abs(int(a) - int(b)) <= 1
    key = lambda r: ("doi", r["doi"]) if r.get("doi") else ("pmid", r["pmid"]) if r.get("pmid") else ("title", r["title"].lower()) if r.get("title") else None
    alike = lambda a, b: max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, b, a).ratio()) >= 0.93
    for a, b in itertools.combinations(rows, 2):
        ta, tb = (" ".join((r.get("title") or "").lower().split()) for r in (a, b))
        clash = any(a.get(c) and b.get(c) and a[c] != b[c] for c in ("doi", "pmid"))
        if (key(a) and key(a) == key(b)) or (min(len(ta), len(tb)) >= 20 and ta[0] == tb[0] and fit(a["year"], b["year"]) and not clash and alike(ta, tb)):
            m, n = sorted((find(a["record_id"]), find(b["record_id"])))
            up[n] = m
    r = records(spark, rows)
    got = {x.record_id: x.group_id for x in linkage.duplicate_groups(r).collect()}
    assert got == {x: find(x) for x in up} and len(set(got.values())) > 5


def test_candidates_lose_no_pair_and_are_few_on_titles_of_one_pattern(spark, monkeypatch):
    """Titles of one pattern share all their rare parts; long ones need more than one word of bits. Divided into parts as well."""
    rnd = random.Random(5)
    words = ["cluster", "sampling", "claim ledger", "run ledger", "outcome", "assay plate", "exclusion rule", "power estimate"]
    titles = {f"pooled {a} and {b} under {c} conditions" for a, b, c in itertools.product(words, words, ["adjusted", "unadjusted", "delayed", "derived", "blinded"])}
    for _ in range(60):
        t = list(("panel of 0_9 notes " * 12)[: rnd.choice([60, 66, 130, 220])])
        for _ in range(rnd.randrange(1, len(t) // 10)):
            t[rnd.randrange(1, len(t))] = rnd.choice(["", "q", "zz"])
        titles.add("".join(t))
    alike = {tuple(sorted((x, y))) for x, y in itertools.combinations(titles, 2) if difflib.SequenceMatcher(None, x, y).real_quick_ratio() >= 0.93 and difflib.SequenceMatcher(None, x, y).quick_ratio() >= 0.93 and max(difflib.SequenceMatcher(None, x, y).ratio(), difflib.SequenceMatcher(None, y, x).ratio()) >= 0.93}
    items = spark.createDataFrame([(t,) for t in sorted(titles)] + [(None,)], "t string")
    for one, part in ((10**6, 10**6), (100, 8000)):
        monkeypatch.setattr(similar, "ONE", one)
        monkeypatch.setattr(similar, "PART", part)
        got = [(r.a, r.b) for r in similar.candidates(items, "t", 0.93).collect()]
        assert alike <= set(got) and len(alike) > 300 and len(got) == len(set(got)) < 2 * len(alike)


def test_records_of_one_title_with_and_without_identifier_are_merged(spark):
    r = records(spark, [{"record_id": "a", "title": "A delayed assay plate in trials", "year": "2020", "doi": "10.1/x"}, {"record_id": "b", "title": "A delayed assay plate in trials", "year": "2020", "pmid": "7"}, {"record_id": "c", "title": "A delayed assay plate in trials", "year": "2020", "doi": "10.1/y", "pmid": "8"}])
    assert {x.record_id: x.group_id for x in linkage.duplicate_groups(r).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_cosine_pairs_and_clusters_against_all_pairs(spark):
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    docs = spark.createDataFrame([(f"d{i:02}", " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for i in range(40)], "k string, t string")
    w = linkage.tfidf(docs, "k", F.col("t")).cache()
    vec = {}
    for r in w.collect():
        vec.setdefault(r.k, {})[r.term] = r.weight
    assert all(sum(v * v for v in d.values()) == pytest.approx(1) for d in vec.values())
    want = {(a, b) for a, b in itertools.combinations(sorted(vec), 2) if sum(v * vec[b].get(t, 0) for t, v in vec[a].items()) >= 0.4}
    assert {(r.a, r.b) for r in linkage.cosine_pairs(w, "k", 0.4).collect()} == want
    c = {r.k: r for r in linkage.threshold_clusters(w, "k", 0.4).collect()}
    assert all(c[a].cluster_id == c[b].cluster_id for a, b in want) and sum(r.links for r in c.values()) == 2 * len(want) and "C001" in {r.cluster_id for r in c.values()}


# ---- audits

def test_span_parsing_coverage_and_sections(spark):
    t = "# One\n\nAB<!-- CLAIM:x -->claimed<!-- END-CLAIM:x -->\n\n## Two\n<!-- CLAIM:y -->open <!-- END-CLAIM:z -->"
    sp = spans.document_spans(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string"))
    rows = {(r.kind, r.name): t[r.start : r.end] for r in sp.collect()}
    assert rows["claim", "x"] == "claimed" and ("unclosed", "y") in rows and ("unopened", "z") in rows and rows["section", "One"].startswith("# One")
    assert max(r.covered for r in spans.coverage(sp, "doc_id").collect()) == len("claimed")
    assert [r.section for r in spans.sections_of(sp.where("kind = 'claim'").select("doc_id", "name", "start"), sp, "doc_id", "start").collect()] == ["One"]
    claims = spark.createDataFrame([("x", "active"), ("w", None)], "claim_id string, lifecycle_state string")
    assert {r[0] for r in rules(manuscript.span_audit(sp, claims))} == {"marker", "no_span"}
    ov = spans.overlaps(spark.createDataFrame([("d", 0, 5, "a"), ("d", 3, 9, "b"), ("d", 9, 10, "c"), ("d", 1, 2, "e")], "d string, s int, t int, i string"), ["d"], "s", "t", "i", Scratch(spark, "t"))
    assert {r.i for r in ov.collect()} == {"b", "e"}


def test_run_audits(spark):
    planned = spark.createDataFrame([("r1", 1, "c"), ("r2", 2, "c"), ("r3", 3, "d")], "run_id string, seed int, condition string")
    att = spark.createDataFrame([("r1", "a1", 1, "c"), ("r2", "a2", 9, "c"), ("rx", "a3", 1, "c")], "run_id string, attempt_id string, seed int, condition string")
    assert {(r, e) for r, e, _ in rules(runs.planned_runs(planned, att, ["seed", "condition"]))} == {("never_attempted", "r3"), ("unplanned", "a3"), ("differs_from_plan", "a2")}
    times = spark.createDataFrame([("ok", "2024-01-01T00:00:00.0Z", "2024-01-01T00:00:10.0Z", 10.05), ("bad", "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:10.000Z", 10.05), ("zone", "2024-01-01T00:00:00", "2024-01-01T00:00:10Z", 10.0), ("back", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", 1.0)], "attempt_id string, started_at string, finished_at string, runtime_seconds double")
    assert {(r, e) for r, e, _ in rules(runs.attempt_times(times))} == {("runtime", "bad"), ("time_without_zone", "zone"), ("ends_before_start", "back")}
    m = spark.createDataFrame([("r", "a", {"acc": 1.0, "x": math.nan}), ("r", "b", {"acc": math.inf})], "run_id string, attempt_id string, metrics map<string,double>")
    assert {r[0] for r in rules(runs.metric_records(m, ["acc", "loss"]))} == {"metric_missing", "metric_unexpected", "metric_not_finite"}
    claims = spark.createDataFrame([("c1", "Acc", 0.8, "absolute", 0.05, None), ("c2", "acc", 0.8, "relative", 0.01, None), ("c3", "acc", 0.8, "exact", None, None), ("c4", "acc", 0.8, "reported", 0.7, 0.9)], "claim_id string, metric string, value double, rule string, a double, b double")
    mets = spark.createDataFrame([("k", "c1", "acc", 0.84), ("k", "c2", "acc", 0.84), ("bad", "c3", "acc", 0.8), ("k", "c4", "ACC", 0.7)], "run_id string, claim_id string, metric string, value double")
    rs = spark.createDataFrame([("k", 0, "target"), ("bad", 1, "target")], "run_id string, exit_code int, run_kind string")
    state = runs.reconcile_claims(claims, mets, rs)
    assert {r.claim_id: r.state for r in state.collect()} == {"c1": "reproduced", "c2": "not_reproduced", "c3": "not_assessed", "c4": "reproduced"}
    assert rules(runs.release_gate(claims, state))[0][:2] == ("not_assessed", "c3")
    env = spark.createDataFrame([("a", {"PATH": "x", "MY_API_KEY": "y"})], "attempt_id string, environment map<string,string>")
    assert {r[0] for r in rules(runs.environment(env, ["PATH", "LANG"]))} == {"environment_missing", "credential"}
    w = findings.retries(spark.createDataFrame([("r", "1", 0, 5, True), ("r", "2", 3, 6, False)], "run string, i string, s int, f int, ok boolean"), ["run"], "s", F.col("f"), F.col("ok"), "i", Scratch(spark, "t"))
    assert [(r.i, r.after_success, r.overlap) for r in w.orderBy("i").collect()] == [("1", False, False), ("2", True, True)]
    st = runs.stale_from(spark.createDataFrame([("p", 1, True), ("p", 2, False), ("p", 3, True), ("q", 1, True)], "p string, i int, ok boolean"), "p", "i", "ok")
    assert {r.p: (r.first_invalid, r.stale) for r in st.collect()} == {"p": (2, 2), "q": (None, 0)}


def test_figure_audits(spark):
    ents = spark.createDataFrame([("a", "A", 0.0, 0.0, 10.0, 10.0), ("b", "", 5.0, 0.0, 10.0, 10.0), ("c", "C", 900.0, 0.0, 10.0, 10.0), ("in", "I", 1.0, 1.0, 2.0, 2.0)], "id string, label string, x double, y double, w double, h double")
    rel = spark.createDataFrame([("r", "a", "c", "flow", 10.0, 5.0, 890.0, 5.0), ("s", "a", "zz", "odd", 0.0, 0.0, 0.0, 0.0)], "id string, source string, target string, type string, x1 double, y1 double, x2 double, y2 double")
    assert {r[:2] for r in rules(figures.specification(ents, rel, ["flow"]))} == {("no_such_target", "s"), ("unknown_relation", "s"), ("no_label", "b")}
    assert {r[:2] for r in rules(figures.route_gaps(ents, rel, 1.0))} == {("target_gap", "r")}
    inside = spark.createDataFrame([("a", "in")], "parent string, child string")
    assert [(r.a, r.b, r.ratio) for r in figures.box_overlaps(ents, inside, 0.1).collect()] == [("a", "b", 0.5)]
    ev = spark.createDataFrame([("k1", "1", "base", {"clarity": 5.0}, [("style", "minor")]), ("k1", "2", "new", {"clarity": 7.0}, [("style", "awful")]), ("k2", "1", "base", {"clarity": 11.0}, [])], "case_id string, run_id string, variant string, scores map<string,double>, failures array<struct<category:string,severity:string>>")
    assert {r[0] for r in rules(figures.evaluation_records(ev, ("clarity",)))} == {"severity", "score_range"}
    w = figures.win_tie_loss(figures.paired_scores(ev, "base", "new", "clarity")).collect()[0]
    assert (w.cases, w.wins, w.mean_delta) == (1, 1, 2.0)
    assert {(r.severity, r.category): r.n for r in figures.failure_counts(ev).collect()}[None, None] == 2
    g = figures.grounding(spark.createDataFrame([("c", ["x"]), ("d", [])], "id string, anchor_ids array<string>"), spark.createDataFrame([("y",)], "id string"))
    assert {r[:2] for r in rules(g)} == {("no_such_anchor", "c"), ("ungrounded", "d"), ("unused_anchor", "y")}


def test_manuscript_audits(spark):
    c = spark.createDataFrame([("a", "Rose by 5.2 and 7", ["5.2", "9"], [("b", "paragraph"), ("z", "document")])], "claim_id string, text string, required_value_tokens array<string>, required_companions array<struct<claim_id:string,scope:string>>")
    assert rules(manuscript.value_closure(c)) == [("value_not_in_text", "a", "9"), ("value_not_required", "a", "7")]
    places = spark.createDataFrame([("a", "p1", "s"), ("b", "p2", "s")], "claim_id string, paragraph_id string, section string")
    assert {r[0] for r in rules(manuscript.companions(c, places))} == {"companion_not_in_paragraph", "companion_missing"}
    sec = spark.createDataFrame([("d", "Results", 0, "a b c"), ("d", "methods", 9, "x"), ("d", "methods", 20, "y")], "doc_id string, name string, start int, text string")
    assert {r[0] for r in rules(manuscript.writing_profile(sec, ["methods", "results", "discussion"], {"results": 2}))} == {"order", "section_missing", "section_repeated", "too_long"}
    assert sorted(r.name for r in manuscript.numbered_names(sec).collect()) == ["Results", "methods", "methods (2)"]
    old = spark.createDataFrame([("d", "m", "one\n\ntwo"), ("d", "x", "gone")], "doc_id string, name string, text string")
    new = spark.createDataFrame([("d", "m", "one\n\nthree")], "doc_id string, name string, text string")
    df = {r.name: r for r in manuscript.section_diff(old, new).collect()}
    assert df["x"].change == "removed" and df["m"].preserved == 0.5 and 0 < df["m"].similarity < 1
    ob = spark.createDataFrame([("o1", "closed", ["fix"], []), ("o2", "open", ["fix"], ["k", "nope"])], "obligation_id string, status string, required_actions array<string>, change_ids array<string>")
    ch = spark.createDataFrame([("k", ["other"])], "change_id string, actions array<string>")
    assert {r[:2] for r in rules(manuscript.obligations(ob, ch))} == {("closed_without_change", "o1"), ("no_such_change", "o2"), ("action_not_done", "o1"), ("action_not_done", "o2")}


def test_anchors_contracts_and_cluster_terms(spark):
    anchors = spark.createDataFrame([("p1", "a", "Fig. 2"), ("p2", "b", "Fig. 2"), ("p9", "c", None)], "anchor string, claim_id string, label string")
    paras = spark.createDataFrame([("p1", "See fig. 2: 5.1 rose"), ("p2", "nothing")], "anchor string, text string")
    claims = spark.createDataFrame([("a", ["5.1", "7"]), ("b", [])], "claim_id string, required_value_tokens array<string>")
    assert {r[:2] for r in rules(manuscript.anchor_consistency(anchors, paras, claims))} == {("no_such_anchor", "c"), ("label_not_in_paragraph", "b"), ("label_at_several_anchors", "fig. 2"), ("value_not_at_anchor", "a")}
    con = spark.createDataFrame([("k", ["e1", "gone"], ["Results", "Methods"], False)], "contract_id string, evidence_ids array<string>, required_sections array<string>, abstract_eligible boolean")
    cl = spark.createDataFrame([("a", "results", ["e1"]), ("b", "Abstract", [" e1"])], "claim_id string, section string, evidence_ids array<string>")
    ev = spark.createDataFrame([("e1",)], "evidence_id string")
    assert {r[:2] + r[2:] for r in rules(manuscript.reporting_contracts(con, cl, ev))} == {("no_such_evidence", "k", "gone"), ("not_reported", "k", "methods"), ("not_for_the_abstract", "k", "b")}
    w = spark.createDataFrame([("d1", "x", 0.5), ("d1", "y", 0.4), ("d2", "y", 0.4), ("d3", "z", 1.0)], "k string, term string, weight double")
    c = spark.createDataFrame([("d1", "C001"), ("d2", "C001"), ("d3", "C002")], "k string, cluster_id string")
    assert sorted((r.cluster_id, r.rank, r.term) for r in linkage.cluster_terms(w, c, "k", 1).collect()) == [("C001", 1, "y"), ("C002", 1, "z")]


def test_hashing(spark):
    h = [r.h for r in spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ('{"a":[1,2],"b":1}',), ("x",), (None,)], "j string").select(hashing.canonical_hash(F.col("j")).alias("h")).collect()]
    assert h[0] == h[1] and h[2] is None and h[3] is None
    import hashlib

    seed = spark.range(1).select(hashing.stable_seed(F.lit(42), F.lit("x")).alias("s")).collect()[0].s
    assert seed == int.from_bytes(hashlib.sha256(b"42::x").digest()[:4], "big")
    a = hashing.record_state(spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "k string, v string"), "l", "k", ["v"])
    b = hashing.record_state(spark.createDataFrame([("1", "x"), ("2", "z"), ("4", "")], "k string, v string"), "l", "k", ["v"])
    assert {(r.id, r.change) for r in hashing.diff_states(a, b).collect()} == {("2", "changed"), ("3", "removed"), ("4", "added")}
    assert hashing.state_id(a).collect() == hashing.state_id(a.repartition(3)).collect() != hashing.state_id(b).collect()


# ---- sources, sinks, streams

def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b,\"c\"", None)], "i int, s string, x double")
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        sinks.write_verified(df, f"{tmp_path}/t.{kind}")
    assert readers.read_table(spark, f"{tmp_path}/t.parquet").count() == 2 and readers.read_table(spark, f"{tmp_path}/t.jsonl").columns == ["file", "value", "v"]
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/t.xls")
    with pytest.raises(Exception):
        sinks.write_table(df, f"{tmp_path}/t.csv")
    bad = spark.createDataFrame([(math.inf,), (math.nan,), (1.0,)], "x double")
    assert [r.x for r in sinks.finite(bad).collect()] == [None, None, 1.0]
    assert sinks.append_once(df, f"{tmp_path}/a", ["i"]) == 2 and sinks.append_once(df, f"{tmp_path}/a", ["i"]) == 0


def test_lenient_and_polymorphic_records(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{bad\n[1]\n\n{"a": 2}\n')
    good, bad = readers.read_jsonl_lenient(spark, f"{tmp_path}/l.jsonl", "a int")
    assert sorted(r.value for r in bad.collect()) == ["[1]", "{bad"]
    assert {r.a for r in good.collect() if r.a is not None} == {1, 2}
    for name, text in (("x.json", '{"items": [{"a": 1}, {"a": 2}]}'), ("y.json", '[{"a": 1}, {"a": 2}]'), ("z.jsonl", '{"a": 1}\n{"a": 2}\n'), ("w.csv", "﻿a,b\n1,\n2,x\n")):
        (tmp_path / name).write_text(text)
        assert [str(json.loads(r.record)["a"]) for r in readers.read_records(spark, f"{tmp_path}/{name}").collect()] == ["1", "2"]


def workbook():
    cell = '<c r="{r}" t="{t}"><v>{v}</v></c>'
    rows = '<row><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="inlineStr"><is><t>flag</t></is></c></row><row>' + cell.format(r="A2", t="n", v="1.5") + cell.format(r="B2", t="b", v="1") + "</row><row></row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_archives_markup_listing(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook())
    r = readers.read_workbook(spark, f"{tmp_path}/b.xlsx").select("row", F.to_json("v").alias("j")).collect()
    assert len(r) == 1 and json.loads(r[0].j) == {"id": 1.5, "flag": True}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../out.txt", "y")
    m = {x.member: x for x in readers.archive_members(spark, f"{tmp_path}/a.zip").collect()}
    assert m["../out.txt"].unsafe and not m["ok.txt"].unsafe and m["ok.txt"].size == 1
    (tmp_path / "f.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg"><g id="g"><text>hi</text></g></svg>')
    e = {x.tag: x for x in readers.markup_elements(spark, f"{tmp_path}/f.svg").collect()}
    assert e["text"].text == "hi" and e["g"].attributes == {"id": "g"} and e["text"].parent == e["g"].ordinal
    names = {x.name for x in readers.list_files(spark, str(tmp_path)).collect()}
    assert {"b.xlsx", "a.zip", "f.svg"} <= names
    assert {x.kind for x in readers.classify_files(readers.list_files(spark, str(tmp_path)), {"figure": r"\.svg$", "archive": r"\.zip$"}).collect()} == {"figure", "archive"}


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(i, datetime(2024, 1, 1, i % 3, 5), "a" if i % 2 else "b", float(i)) for i in range(12)], "id long, ts timestamp, kind string, value double")
    ev.repartition(3).write.parquet(f"{tmp_path}/in")
    st = streaming.stream_table(spark, f"{tmp_path}/in", "id long, ts timestamp, kind string, value double", 1)
    got = streaming.drain(streaming.windowed_counts(st, "ts", ["kind"], "value", late="1 day"), Scratch(spark, "t"), "w", "complete")
    assert sum(r.n for r in got.collect()) == 12 and got.count() == 6
    for _ in range(2):
        streaming.append_stream(st, f"{tmp_path}/out", ["id"], f"{tmp_path}/progress")
    streaming.append_stream(st, f"{tmp_path}/out", ["id"], f"{tmp_path}/progress2")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12
