"""Rules that small cases pin down: exact rank tests, one-sided plans, walks that stream, divided filters, names that differ by case."""

import itertools
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.functions import dist
from auditloom.operators import drift, hierarchy, power, references, stats
from auditloom.scratch import Scratch
from auditloom.sources import sinks


def test_exact_rank_tests_against_all_orders():
    for na, nb in ((2, 2), (3, 4), (5, 3)):
        us = [sum(sum(y > x for x in range(na + nb) if x not in b) for y in b) for b in itertools.combinations(range(na + nb), nb)]
        for u in range(na * nb + 1):
            want = min(1.0, 2 * sum(v >= max(u, na * nb - u) for v in us) / len(us))
            assert dist.mann_whitney_exact(u, na, nb) == pytest.approx(want)
    assert dist.mann_whitney_exact(4, 2, 2) == pytest.approx(1 / 3)
    for n in (1, 3, 6):
        ws = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            want = min(1.0, 2 * sum(v <= min(w, n * (n + 1) // 2 - w) for v in ws) / len(ws))
            assert dist.wilcoxon_exact(w, n) == pytest.approx(want)


def test_one_sided_plans_and_a_given_zero():
    item = {"type": "welch_two_group_mean", "solve_for": "sample_size", "mean_difference": 5, "sd_a": 10, "sd_b": 10}
    for a, b, effect in (("larger", "greater", 5), ("smaller", "less", -5)):
        one, two = [power.plan_item(item | {"alternative": x, "mean_difference": effect}, {}) for x in (a, b)]
        assert one == two and one["n"] == 51 and one["problem"] is None
    assert power.plan_item(item | {"alpha": 0}, {})["problem"] and power.plan_item(item | {"alternative": "up"}, {})["problem"]


def test_a_walk_streams_its_paths():
    """A chain's paths grow with the square of its length; no batch does."""
    n = 6000
    links = pa.RecordBatch.from_pydict({"component": ["c"] * (n - 1), "child": [f"n{i:05}" for i in range(1, n)], "parent": [f"n{i:05}" for i in range(n - 1)]})
    rows = chars = 0
    for b in hierarchy._walk(hierarchy.traverse, hierarchy._OUT, 3)(iter([links])):
        size = sum(map(len, b.column("path").to_pylist()))
        assert b.num_rows <= hierarchy.BATCH_ROWS and size <= hierarchy.BATCH_CHARS + 7 * n
        rows, chars = rows + b.num_rows, chars + size
    assert rows == n and chars == sum(7 * i + 6 for i in range(n))


def test_descendants_by_walk_and_by_joins(spark, rows):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("y", "x"), ("x", "y"), ("z", "y"), (None, "a"), ("b", "a")], "child string, parent string")
    want = sorted([("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "e", 3), ("b", "c", 1), ("b", "d", 1), ("b", "e", 2), ("d", "e", 1)], key=repr)
    assert rows(hierarchy.descendants(links)) == want
    assert rows(hierarchy.descendants(links, max_nodes=2)) == want
    assert rows(hierarchy.descendants(links.limit(0))) == []


def test_divided_filters_lose_no_key(spark, monkeypatch):
    monkeypatch.setattr(references, "MAX_BITS", 512)
    keys = spark.range(400).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    blooms = references.bloom_filters(keys, "k", 400)
    assert len(blooms) == references.MAX_FILTERS
    assert keys.where(~references.might_contain(blooms, F.col("k"))).count() == 0
    absent = spark.range(400).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("k"))
    assert absent.where(~references.might_contain(blooms, F.col("k"))).count() > 100


def test_fields_that_differ_by_case_are_two_columns(spark):
    recs = [{"claim_id": "1", "Anchor_Precision": "a", "anchor_precision": "b", "x": None}]
    lines = spark.createDataFrame([("s", "claims", "f", None, None, 0, json.dumps(r)) for r in recs], "stream_id string, artifact string, file_name string, exported_at timestamp, arrived_at timestamp, line_no int, payload string")
    r = drift.promote(drift.ingest(lines, "claims"), {"Anchor_Precision": "string"}).collect()[0]
    assert (r.anchor_precision, r.Anchor_Precision_2, json.loads(r._rescued)) == ("b", "a", {"x": None})


def test_refused_comparisons_name_the_level(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), ("c", 4.0), ("c", 4.0)], "g string, y double")
    r = stats.welch_anova(t, "g", "y", ["a", "b", "d"]).collect()[0]
    assert r.statistic is None and "level d" in r.problem
    assert "level c has no variance" == stats.welch_anova(t, "g", "y", ["a", "b", "c"]).collect()[0].problem
    assert stats.welch_contrast(t, "g", "y", {"a": 1.0, "b": -1.0}).collect()[0].estimate == -2.5


def test_paths_stay_inside_and_counts_come_with_the_write(spark):
    assert sinks.inside("/data/out", "a/b.csv") == "/data/out/a/b.csv" and sinks.inside("/data/out", "/data/out/x") == "/data/out/x"
    for bad in ("../x", "/data/outside", "a/../../x"):
        with pytest.raises(ValueError):
            sinks.inside("/data/out", bad)
    df, n = Scratch(spark, "counted").counted(spark.range(10), "t", F.col("id") > 6)
    assert n == 3 and df.count() == 10
