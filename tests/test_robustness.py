"""Null rows, repeated rows, clashing column names and empty tables change nothing."""

import pytest
from robust import copies, rows

from auditloom.plans import problems

CASES = {
    "p1_found": ["ledger_files"], "p1_claims": ["ledger_files"], "p3_found": ["power_plan", "claims"], "p4_found": ["results", "results_copy"],
    "p5_found": ["claims", "citation_trail", "evidence", "sources", "records"], "p6_found": ["claims"], "p7_found": ["workspace_state"],
}


@pytest.mark.parametrize("name", CASES)
def test_same_result(spark, tmp_path, name):
    plain, more, none = copies(spark, tmp_path, CASES[name])
    q = problems.QUERIES[name]
    want = rows(q(spark, plain))
    assert want and rows(q(spark, more)) == want
    assert rows(q(spark, none)) == []
