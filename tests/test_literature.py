"""Screening rules, search coverage, flows, studies and syntheses on small inline ledgers."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import literature as lit


def rules(df):
    return {(r.rule, r.entity_id) for r in df.collect()}


def test_rules(spark):
    r = spark.createDataFrame([("a", "Primary OUTCOME of X", "editorial", "k1; K2", None), ("b", None, " ", None, "2020")], "record_id string, title string, publication_type string, keywords string, year string")
    rs = [{"id": "any", "op": "contains_any", "field": "title", "values": ["outcome", "zz"]}, {"id": "all", "op": "contains_all", "field": "title", "values": ["primary", "zz"]}, {"id": "eq", "op": "equals", "field": "publication_type", "values": ["Editorial"]}, {"id": "list", "op": "list_contains_any", "field": "keywords", "values": ["k2"]}, {"id": "rx", "op": "regex", "field": "title", "pattern": r"of\s+x$"}, {"id": "has", "op": "exists", "field": "year"}, {"id": "no", "op": "missing", "field": "year"}, {"id": "off", "op": "exists", "field": "title", "enabled": False}]
    assert {tuple(x) for x in lit.matching_rules(r, rs).collect()} == {("a", "any"), ("a", "eq"), ("a", "list"), ("a", "rx"), ("a", "no"), ("b", "has")}
    assert lit.matching_rules(r, []).count() == 0
    with pytest.raises(ValueError):
        lit.rule_condition({"id": "x", "op": "nope", "field": "title"})
    derived = lit.derive_type_rules("We exclude editorials and letters. Datasets are kept. Comments were not excluded.")
    assert [d["id"] for d in derived] == ["type_editorial", "type_letter"]
    assert lit.merge_rules([{"id": "type_letter", "op": "missing", "field": "x"}], derived)[0]["op"] == "missing"
    done = lit.new_decisions(lit.matching_rules(r, rs[:3]), spark.createDataFrame([("b",)], "record_id string")).collect()
    assert [(d.record_id, d.reason_code) for d in done] == [("a", "any")]
    left = spark.createDataFrame([("a", "Uncertain")], "record_id string, decision string")
    assert rules(lit.uncertain_with_rule(left, r, rs[2:3])) == {("uncertain_but_ruled", "a")}


LOG = "query_id string, search_stage string, source string, searched_at string, search_status string, result_count string, imported_count string, new_unique_count string, new_screened_count string, new_included_count string, stopping_evidence string, notes string"


def test_search(spark):
    log = spark.createDataFrame([("q1", "main", "A", "2024", "", "5", "5", "4", "4", "1", "", ""), ("q1", "main", "B", "", "succeeded", "9", "3", "3", "3", "0", "", ""), (None, "snow", "C", "2024", "", "", "", "", None, None, "none new", "request failed"), ("q3", "snow", "X", "2024", "", "1", "2", "3", "1", "0", "", "")], LOG)
    st = {r.source: r.status for r in lit.source_status(log, ["A", "B", "C", "D"]).collect()}
    assert st == {"A": "succeeded", "B": "partial", "C": "failed", "D": "not_attempted"}
    got = rules(lit.search_audit(log, ["A", "B", "C", "D"], ["main", "update"]))
    assert {("source_coverage", "C"), ("source_coverage", "D"), ("source_coverage", "B"), ("no_query_id", "C"), ("repeated_query_id", "q1"), ("no_date", "q1"), ("counts", "q3"), ("stage_missing", "update"), ("unknown_source", "q3")} == got
    y = {r.search_stage: r for r in lit.marginal_yield(log).collect()}
    assert y["main"].included == 1 and y["main"].stopping == "unsupported" and y["snow"].stopping == "incomplete"
    s = lit.sum_known(log, "new_screened_count").collect()[0]
    assert (s.total, s.known, s.missing) == (8, 3, 1)


def test_studies_and_synthesis(spark):
    studies = spark.createDataFrame([("a", "S1", "primary", None), ("b", "S1", "secondary", None), ("c", "S2", "secondary", "same cohort"), ("c", "S1", "secondary", "x"), ("z", None, None, None)], "record_id string, study_id string, report_role string, linkage_basis string")
    screening = spark.createDataFrame([("a", "include"), ("b", "include"), ("c", "Include"), ("d", "include"), ("z", "exclude")], "record_id string, decision string")
    assert rules(lit.study_audit(studies, screening)) == {("included_without_study", "d"), ("mapped_not_included", "z"), ("several_studies", "c"), ("primary_reports", "S2"), ("no_linkage_basis", "b")}
    assert {r.study_id: r.reports for r in lit.study_summary(studies).collect()} == {"S1": 3, "S2": 1}
    ev = spark.createDataFrame([("c1", "r1", "S1", "direct", "verified"), ("c2", "r2", "S2", "derived", "partial"), ("c3", "r3", None, "direct", "verified"), ("c4", "r4", "S4", "indirect", "verified")], "claim_id string, source_id string, study_id string, support_level string, verification_status string")
    links = spark.createDataFrame([("y1", "c1", "supports"), ("y1", "c2", "supports"), ("y2", "c1", "supports"), ("y2", "c3", "contradicts"), ("y3", "c3", "supports"), ("y4", "c4", "supports")], "synthesis_id string, claim_id string, relation string")
    st = lit.synthesis_states(links, ev)
    assert {r.synthesis_id: r.state for r in st.collect()} == {"y1": "consistent", "y2": "mixed", "y3": "single_source", "y4": "gap"}
    said = spark.createDataFrame([("y1", "It holds", "consistent"), ("y3", "X causes Y", "consistent"), ("y9", " ", "gap")], "synthesis_id string, statement string, evidence_state string")
    assert rules(lit.synthesis_audit(said, st)) == {("evidence_state", "y3"), ("causal_wording", "y3"), ("no_statement", "y9")}


def test_flow_and_repeated_full_text(spark):
    f = spark.createDataFrame([("found", 1, 10, 3), ("screened", 2, 7, 2), ("included", 3, 4, 0)], "stage string, position int, entered long, removed long")
    assert rules(lit.flow(f)) == {("flow", "screened")}
    e = spark.createDataFrame([("a", "full_text", "pdf", "include"), ("a", "full_text_screened", "pdf", "include"), ("b", "title_abstract", "x", "include"), ("b", "title_abstract", "x", "include")], "record_id string, stage string, evidence_basis string, decision string")
    assert rules(lit.duplicate_fulltext(e)) == {("repeated_full_text", "a")}


def test_result_sanity(spark):
    r = spark.createDataFrame([("a", "1", 1.0, 0.5, 2.0, 0.95, 2.0, 0.5, 0.6, 1.0, 10), ("a", "2", 5.0, 0.5, 2.0, 0.95, 2.0, 1.5, 0.6, 1.0, -1), ("a", " ", None, None, None, None, None, None, None, float("nan"), None)], "analysis_id string, analysis_item_id string, estimate double, ci_low double, ci_high double, ci_level double, statistic double, p_value double, p_adjusted double, effect_size double, n long")
    assert rules(lit.result_sanity(r)) == {("p_range", "a/2"), ("p_adjusted", "a/2"), ("estimate_outside", "a/2"), ("n", "a/2"), ("blank_key", "a/"), ("p_missing", "a/"), ("not_finite", "a/")}
    assert lit.result_sanity(r.where(F.lit(False))).count() == 0
