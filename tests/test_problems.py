"""The general data problems against small cases written out by hand and against brute force."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditloom.operators import compare, drift, hierarchy, references, shred, snapshots
from auditloom.scratch import Scratch

T0 = datetime(2025, 1, 1)
CLASH = ["side", "k", "pair", "value", "series", "pos", "_pid", "previous", "n", "m", "id"]


def day(n):
    return T0 + timedelta(days=n)


def clash(df):
    """The table with extra columns whose names the operators use inside."""
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns])


# ---- drift

LINES = "stream_id string, artifact string, file_name string, exported_at timestamp, arrived_at timestamp, line_no int, payload string"


def lines(spark, files):
    """files: [(name, day, [records or texts])] of one stream of claims."""
    out = []
    for name, d, recs in files:
        for i, r in enumerate(recs):
            out.append(("s", "claims", name, day(d), day(d), i, r if r is None or isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(out, LINES)


def test_drift_kinds(spark, rows):
    a = {"claim_id": "1", "x": 1, "old": "v", "deep": {"p": 1}, "list": [{"q": 1}], "gone": {"below": 1}}
    b = {"claim_id": "1", "x": "1", "new": "v", "deep": {"p2": 1}, "list": [{"q": "a"}], "fresh": None}
    got = rows(drift.drift(clash(lines(spark, [("f1", 1, [a, None, "{", "[]", ""]), ("f2", 2, [b])]))))
    assert got == sorted([("s", "f2", "x", "", "type_changed"), ("s", "f2", "new", "old", "renamed"), ("s", "f2", "deep.p2", "deep.p", "renamed"), ("s", "f2", "list[].q", "", "type_changed"), ("s", "f2", "gone", "", "removed"), ("s", "f2", "fresh", "", "added")], key=repr)


def test_drift_rename_needs_one_partner_and_equal_values(spark, rows):
    a = [{"claim_id": str(i), "a": i, "e": ""} for i in range(3)]
    two = [{"claim_id": str(i), "b": i, "c": i, "f": ""} for i in range(3)]
    assert {r[4] for r in rows(drift.drift(lines(spark, [("f1", 1, a), ("f2", 2, two)])))} == {"added", "removed"}
    off = [{"claim_id": str(i), "b": i if i else 9, "e": ""} for i in range(3)]
    assert rows(drift.drift(lines(spark, [("f1", 1, a), ("f2", 2, off)]))) == [("s", "f2", "a", "", "removed"), ("s", "f2", "b", "", "added")]


def test_drift_true_is_not_one_and_redelivery_counts_once(spark, rows):
    a, b = {"claim_id": "1", "u": 1}, {"claim_id": "1", "v": True}
    assert {r[4] for r in rows(drift.drift(lines(spark, [("f1", 1, [a]), ("f2", 2, [b])])))} == {"added", "removed"}
    again = lines(spark, [("f1", 1, [a]), ("f2", 2, [a]), ("f1", 1, [dict(reversed(a.items()))])])
    assert rows(drift.drift(again)) == []


def test_drift_counts_every_line_of_a_key(spark, rows):
    one, two = {"claim_id": "1", "x": 1, "old": "v"}, {"claim_id": "1", "x": "t", "y": 1, "old": "w"}
    a, b = {"claim_id": "2", "x": 1, "y": 1, "old": "v"}, {"claim_id": "2", "x": 1, "z": 1, "old": "v"}
    # x is number and string before and number after; y and z are each in one line only
    got = rows(drift.drift(lines(spark, [("f1", 1, [one, two, a, b]), ("f2", 2, [{"claim_id": "1", "x": 2, "old": "v"}])])))
    assert got == [("s", "f2", "x", "", "type_changed"), ("s", "f2", "y", "", "removed"), ("s", "f2", "z", "", "removed")]
    got = rows(drift.drift(lines(spark, [("f1", 1, [{"claim_id": "1", "x": 2, "old": "v"}]), ("f2", 2, [one, two, a, b])])))
    assert got == [("s", "f2", "x", "", "type_changed"), ("s", "f2", "y", "", "added"), ("s", "f2", "z", "", "added")]
    # a rename has the same values on all lines of a key
    new = [{("new" if k == "old" else k): v for k, v in r.items()} for r in (one, two, a, b)]
    assert rows(drift.drift(lines(spark, [("f1", 1, [one, two, a, b]), ("f2", 2, new)]))) == [("s", "f2", "new", "old", "renamed")]
    new[1]["new"] = "other"
    assert rows(drift.drift(lines(spark, [("f1", 1, [one, two, a, b]), ("f2", 2, new)]))) == [("s", "f2", "new", "", "added"), ("s", "f2", "old", "", "removed")]
    # two equal values of one key don't cancel out
    assert rows(drift.drift(lines(spark, [("f1", 1, [a, b]), ("f2", 2, [{"claim_id": "2", "x": 1, "y": 1, "new": "q"}, {"claim_id": "2", "x": 1, "z": 1, "new": "q"}])]))) == [("s", "f2", "new", "", "added"), ("s", "f2", "old", "", "removed")]


def test_drift_records_without_key_and_empty(spark, rows):
    a, b = {"x": 1}, {"y": 1}
    assert len(rows(drift.drift(lines(spark, [("f1", 1, [a]), ("f2", 2, [b])])))) == 2
    assert rows(drift.drift(spark.createDataFrame([], LINES))) == []


def test_ingest_rescues_and_promote_replays(spark):
    recs = [{"claim_id": "1", "status": "ok", "hint": "h", "n": 3}, {"claim_id": "2", "status": ["bad"], "hint": 4, "n": 2.5}, {"claim_id": "3"}]
    t = drift.ingest(lines(spark, [("f", 1, recs)]), "claims")
    got = {r.claim_id: r for r in t.collect()}
    assert got["1"].status == "ok" and got["2"].status is None and json.loads(got["2"]._rescued)["status"] == ["bad"] and got["3"]._rescued is None
    p = {r.claim_id: r for r in drift.promote(t, {"hint": "string", "n": "double"}).collect()}
    assert p["1"].hint == "h" and p["1"].n == 3.0 and p["1"]._rescued is None
    assert p["2"].hint is None and p["2"].n == 2.5 and json.loads(p["2"]._rescued) == {"status": ["bad"], "hint": 4}


# ---- shredding

def test_shared_inlining_tables():
    graph = [("plan", "items", True), ("items", "meta", False), ("items", "terms", True), ("over", "terms", True), ("items", "over", False), ("terms", "terms", False)]
    assert shred.tables_of(graph, "plan") == {"plan", "items", "terms"}


PLANS = "planning_id string, plan_version string, payload string"
CLAIMS3 = "claim_id string, required_companions array<struct<claim_id:string,scope:string>>"


def test_nested_parts(spark, rows):
    items = [
        {"planning_item_id": "i1", "contrast_terms": [None, {"weight": " 0.5 "}, {"weight": "n/a"}, {"weight": True}], "scenarios": [None, {"scenario_id": "s1", "overrides": {"mean_difference": 2}}, {"scenario_id": "s2", "overrides": json.dumps({"mean_difference": "3.1", "contrast_terms": {"weight": -1}})}]},
        {"planning_item_id": "i2", "scenarios": {"scenario_id": "only", "overrides": {"mean_difference": 1e-3}}, "contrast_terms": {"weight": 1}},
    ]
    plans = spark.createDataFrame([("p", "1", json.dumps({"planning_items": items}))] * 2 + [("p", "1", "{"), ("q", "1", None), ("r", None, json.dumps({"planning_items": items[1]}))], PLANS)
    claims = spark.createDataFrame([("c", [None, (" x ", "s"), (" ", None), (None, "t")]), ("d", None), ("e", [])], CLAIMS3)
    want = [("term", "p", "1", "i1", "", 1), ("override", "p", "1", "i1", "s1", 1), ("override", "p", "1", "i1", "s2", 2), ("term", "p", "1", "i1", "s2", 0), ("override", "p", "1", "i2", "only", 0), ("term", "p", "1", "i2", "", 0), ("override", "r", "", "i2", "only", 0), ("term", "r", "", "i2", "", 0), ("companion", "c", "", "x", "", 1)]
    assert rows(shred.nested_parts(clash(plans), clash(claims))) == sorted(want, key=repr)


@pytest.mark.parametrize("odd", [
    {"planning_items": {"planning_item_id": "o", "scenarios": [{"scenario_id": "x", "overrides": [{"mean_difference": 1, "contrast_terms": [{"weight": 1}]}]}]}},
    {"planning_items": [{"planning_item_id": "o", "overrides": {"mean_difference": 1, "contrast_terms": [{"weight": 1}]}}], "overrides": {"contrast_terms": [{"weight": 1}]}},
    {"more": {"planning_items": {"planning_item_id": "o", "scenarios": [{"scenario_id": "x", "overrides": {"mean_difference": 1, "contrast_terms": [{"weight": 1}]}}]}}},
    {"planning_items": {"planning_item_id": "o", "more": {"overrides": {"mean_difference": 1, "contrast_terms": [{"weight": 1}]}}}},
    {"overrides": [{"planning_items": [{"scenarios": [{"overrides": {"mean_difference": 1}}]}]}]},
])
def test_one_odd_payload_changes_no_other(spark, rows, odd):
    good = {"planning_items": [{"planning_item_id": "i", "scenarios": [{"scenario_id": "s", "overrides": {"mean_difference": 2, "contrast_terms": [{"weight": 1}]}}]}]}
    plans = spark.createDataFrame([("g", "1", json.dumps(good)), ("odd", "1", json.dumps(odd))], PLANS)
    got = rows(shred.nested_parts(plans, spark.createDataFrame([], CLAIMS3)))
    assert got == [("override", "g", "1", "i", "s", 0), ("term", "g", "1", "i", "s", 0)]


def test_nested_parts_of_single_objects_only(spark, rows):
    doc = {"planning_items": {"planning_item_id": "i", "scenarios": {"scenario_id": "s", "overrides": {"mean_difference": 2, "contrast_terms": {"weight": 1}}}, "contrast_terms": {"weight": "2"}}}
    got = rows(shred.nested_parts(spark.createDataFrame([("p", "1", json.dumps(doc))], PLANS), spark.createDataFrame([], CLAIMS3)))
    assert got == [("override", "p", "1", "i", "s", 0), ("term", "p", "1", "i", "", 0), ("term", "p", "1", "i", "s", 0)]


def test_nested_parts_empty(spark, rows):
    assert rows(shred.nested_parts(spark.createDataFrame([], PLANS), spark.createDataFrame([], CLAIMS3))) == []


def test_shred_foreign_keys(spark):
    docs = spark.createDataFrame([("d", json.dumps({"a": [{"k": 1, "b": [{"v": 2}, {"v": 3}]}], "o": {"s": {"t": 9}}}))], "doc string, payload string")
    got = [r.asDict() for r in shred.shred(docs, "payload", ["doc"], "root", {"a": "k"}).collect()]
    nodes = {r["node"]: r for r in got}
    assert {r["element"] for r in got} == {"root", "a", "b"} and nodes["$"]["columns"]["o.s.t"] == "9"
    assert all(r["parent_node"] in nodes for r in got if r["element"] != "root") and sorted(r["pos"] for r in got if r["element"] == "b") == [0, 1] and {r["parent_keys"]["a"] for r in got if r["element"] == "b"} == {"1"}


# ---- copies

def test_number_rules(spark):
    inf = float("inf")
    cases = [(1.0, "1.0", False), (1.0, " 1e0 ", False), (1.0, "1,0", True), (None, "NA", False), (math.nan, " null ", False), (None, "", False), (None, None, False), (1.0, None, True), (None, "1", True), (inf, "Infinity", False), (inf, "-inf", True), (-inf, "-inf", False), (1e300, "1.0000000001e300", False), (0.0, "1e-13", False), (0.0, "1e-11", True), (1.0, "1.0000000002", True), (1.0, "<1", True), (1.0, "1d", True), (312.0, "312.0", False)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], "a double, b string, w boolean")
    assert [r for r in df.withColumn("g", compare.numbers_differ(F.col("a"), F.col("b"))).collect() if r.g != r.w] == []


def test_copies(spark, rows):
    left = spark.createDataFrame([("a", "1", 1.0, "t", day(1)), ("a", "1", 2.0, "t", day(2)), (" b", "1", 1.0, None, day(1)), (None, "1", 1.0, "t", day(1)), ("c", " ", 1.0, "t", day(1)), ("d", "1", None, "x", None)], "k1 string, k2 string, x double, s string, loaded_at timestamp")
    right = spark.createDataFrame([("a ", "1", "2.0", "t "), ("a ", "1", "2.0", "t "), ("d", "1", "NaN", "y"), ("e", "1", "1", "")], "k1 string, k2 string, x string, s string")
    got = rows(compare.compare_copies(clash(left), clash(right), ["k1", "k2"], ["x"], ["s"], "loaded_at"))
    assert got == [("b", "1", "", "missing_in_copy"), ("d", "1", "s", "differs"), ("e", "1", "", "missing_in_results")]
    assert rows(compare.compare_copies(left.limit(0), right.limit(0), ["k1", "k2"], ["x"], ["s"])) == []


# ---- references

def refs_tables(spark, trail, records):
    claims = spark.createDataFrame([("c1", ["e1", " e2 ", "", None, "e9"], [(" s1", "x"), (None, "y")], day(40)), ("c2", None, None, None), ("c3", ["e3"], [], None)], "claim_id string, evidence_ids array<string>, object_refs array<struct<source_id:string,label:string>>, loaded_at timestamp")
    evidence = spark.createDataFrame([("e1", day(1), None), ("e2", day(1), day(2)), ("e3", day(50), None)], "evidence_id string, loaded_at timestamp, deleted_at timestamp")
    sources = spark.createDataFrame([("s1", day(41), None)], "source_id string, loaded_at timestamp, deleted_at timestamp")
    t = spark.createDataFrame(trail, "source_id string, target_id string, loaded_at timestamp")
    r = spark.createDataFrame(records, "record_id string, loaded_at timestamp, deleted_at timestamp")
    return [clash(x) for x in (claims, t, evidence, sources, r)]


def test_references(spark, rows):
    got = rows(references.ledger_references(*refs_tables(spark, [(None, "r1", day(1)), ("a ", " r2", day(1)), ("a", "r2", day(2)), ("a", None, day(1)), ("b", "nope", None)], [("r1", day(0), day(1)), ("r1", day(3), None), ("r2", day(2), None)])))
    assert got == sorted([("claims.evidence_ids", "c1", "e2", "deleted", "2025-02"), ("claims.evidence_ids", "c1", "e9", "missing", "2025-02"), ("claims.object_refs.source_id", "c1", "s1", "late", "2025-02"), ("citation_trail.target_id", "a", "r2", "late", "2025-01"), ("citation_trail.target_id", "b", "nope", "missing", "")], key=repr)


def test_references_hot_target_and_no_parents(spark, rows):
    trail = [(f"s{i}", "hot" if i % 3 else f"t{i}", day(1)) for i in range(3000)]
    got = rows(references.ledger_references(*refs_tables(spark, trail, [("hot", day(5), None)])).where("ref_field = 'citation_trail.target_id'"))
    assert len(got) == 3000 and sum(r[3] == "late" for r in got) == 2000
    got = rows(references.ledger_references(*refs_tables(spark, trail[:5], [])).where("ref_field = 'citation_trail.target_id'"))
    assert {r[3] for r in got} == {"missing"} and len(got) == 5


def test_references_hold_nothing_on_the_driver(spark, rows):
    """Neither a filter of the parents' keys nor a count of them: the driver's memory doesn't grow with the parents."""
    found = references.ledger_references(*refs_tables(spark, [("a", "r1", day(1)), ("b", "nope", day(1))], [("r1", day(0), None)]))
    assert "subquery" not in found._jdf.queryExecution().analyzed().toString()
    assert [r[1:4] for r in rows(found.where("ref_field = 'citation_trail.target_id'"))] == [("b", "nope", "missing")]


# ---- hierarchies

def brute_tree(links):
    par = {}
    for c, p in links:
        par[c] = min(p, par.get(c, p))
    out = {}
    for n in {x for l in par.items() for x in l}:
        path, seen = [n], {n}
        while path and path[0] in par:
            q = par[path[0]]
            if q in seen:
                path = None
            else:
                seen.add(q)
                path.insert(0, q)
        out[n] = (path[0], len(path) - 1, "/".join(path), 0) if path else ("", -1, "", 1)
    return out


@pytest.mark.parametrize("limit", [3, 100_000])
def test_hierarchy_against_brute_force(spark, limit):
    rnd = random.Random(limit)
    links = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60) if rnd.random() < 0.8] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self"), ("below", "self")] + [(f"c{i}", f"c{i - 1}") for i in range(1, 40)]
    df = spark.createDataFrame([*links, *links[:5], (None, "n1"), ("n1", None)], "child string, parent string")
    got = {r.id: r for r in hierarchy.hierarchy(df, max_nodes=limit).collect()}
    want = brute_tree(links)
    assert {k: (r.root_id, r.depth, r.path, r.cyclic) for k, r in got.items()} == want
    below = {k: sum(f"/{k}/" in f"/{w[2]}" for w in want.values() if w[2]) for k in want}
    assert all(got[k].descendants == (-1 if w[3] else below[k]) for k, w in want.items())


@pytest.mark.parametrize("limit", [3, 100_000])
def test_back_edges_of_components_of_any_size(spark, limit):
    """Circles of 1 to 20 nodes with trees and a long chain below them, beside trees without a circle."""
    rnd = random.Random(5)
    links, want = [], set()
    for n, size in enumerate([1, 2, 3, 7, 20]):
        names = rnd.sample(range(100, 1000), size + 60)
        ids = [f"{n}-{x}" for x in names]
        ring = ids[:size]
        up = dict(zip(ring, ring[1:] + ring[:1]))
        for i in range(size, len(ids)):
            up[ids[i]] = ids[i - 1] if n % 2 and i > size + 25 else ids[rnd.randrange(i)]
        links += up.items()
        want.add((up[min(ring)], min(ring)))
    links += [(f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 40)]
    df = spark.createDataFrame(links, "child string, parent string")
    got = hierarchy.hierarchy(df, max_nodes=limit).collect()
    assert len(got) == len({x for l in links for x in l})
    assert {(r.id, r.back_edge_to) for r in got if r.back_edge_to is not None} == want


def test_back_edges_and_empty(spark, rows):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("s", "s")], "child string, parent string")
    assert {(r.id, r.back_edge_to) for r in hierarchy.hierarchy(df).collect() if r.back_edge_to} == {("b", "a"), ("s", "s")}
    assert rows(hierarchy.hierarchy(df.limit(0))) == []


def test_claim_links(spark, rows):
    c = spark.createDataFrame([("A", [" B ", None, "", "gone"], None), ("B", [], ["A"]), ("B", None, None), ("C", None, ["B"])], "claim_id string, supersedes_claim_ids array<string>, superseded_by_claim_ids array<string>")
    assert rows(hierarchy.claim_links(clash(c))) == [("B", "A"), ("C", "B")]


# ---- snapshots

STATES = "project_id string, snapshot_id string, taken_at timestamp, arrived_at timestamp, payload string"


def brute_changes(states):
    out = set()
    series = {}
    for p, s, t, e in states:
        series.setdefault(p, []).append((t, s, e))
    for p, snaps in series.items():
        snaps.sort(key=lambda x: (x[0], x[1]))
        for (_, _, a), (_, s, b) in zip(snaps, snaps[1:]):
            out |= {(p, s, *k, "added") for k in b.keys() - a.keys()} | {(p, s, *k, "removed") for k in a.keys() - b.keys()} | {(p, s, *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_snapshot_changes_against_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    states, entries, snaps = [], [], []
    for p in ("hot", "b"):
        e = {("f", f"k{i}"): "v" for i in range(60)}
        for n in range(12 if p == "hot" else 3):
            for _ in range(6):
                e[rnd.choice("fg"), f"k{rnd.randrange(80)}"] = rnd.choice(["v", "w", None])
                e.pop(rnd.choice(sorted(e)), None)
            states.append((p, f"{p}{n}", day(n), dict(e)))
            snaps.append((p, f"{p}{n}", day(n)))
            entries += [(p, f"{p}{n}", s, k, v) for (s, k), v in e.items()]
    got = snapshots.snapshot_changes(spark.createDataFrame(entries, "series string, snapshot string, section string, entry string, value string"), spark.createDataFrame(snaps, "series string, snapshot string, taken_at timestamp"), Scratch(spark, "t"), chunk)
    assert {tuple(r) for r in got.collect()} == brute_changes(states)


def test_workspace_changes(spark, rows):
    s1 = {"state_id": "A", "files": {"f": "H", "n": None}, "source_files": None, "records": {"claims": {"c": "1"}, "x": None}}
    s2 = {"state_id": "a", "files": {"f": "h", "n": "1"}, "source_files": {"S": {"sha256": None, "path": "p"}}}
    late = {"state_id": "old"}
    df = spark.createDataFrame([("P", "2", day(2), day(9), json.dumps(s2)), ("P", "2", day(2), day(3), json.dumps(late)), ("P", "1", day(1), day(20), json.dumps(s1)), ("P", "3", day(3), day(3), "{"), ("Q", "q", day(1), day(1), json.dumps(s1)), (None, "z", day(1), day(1), "{}")], STATES)
    got = rows(snapshots.workspace_changes(clash(df)))
    assert [r for r in got if r[1] == "2"] == [("P", "2", "files", "n", "changed"), ("P", "2", "records.claims", "c", "removed"), ("P", "2", "source_files", "S", "added")]
    assert {r[4] for r in got if r[1] == "3"} == {"removed"} and not [r for r in got if r[0] == "Q"]
    assert rows(snapshots.workspace_changes(df.limit(0))) == []


@pytest.mark.parametrize("chunk", [2, 8])
def test_snapshots_delivered_twice(spark, chunk, monkeypatch):
    """Every delivery there twice or three times, while neighbours gain and lose entries: what stays the same is no change."""
    monkeypatch.setattr(snapshots.snapshot_changes, "__defaults__", (chunk,))
    rnd = random.Random(chunk)
    states, out = [], []
    e = {f"k{i}": "v" for i in range(40)}
    for n in range(10):
        for _ in range(8):
            e[f"k{rnd.randrange(60)}"] = rnd.choice(["v", "w", None])
            e.pop(rnd.choice(sorted(e)), None)
        states.append(("P", f"s{n}", day(n), {("files", k): v for k, v in e.items()}))
        out += [("P", f"s{n}", day(n), day(n), json.dumps({"files": e}))] * (1 + n % 3)
    got = snapshots.workspace_changes(spark.createDataFrame(out, STATES)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_changes(states)
