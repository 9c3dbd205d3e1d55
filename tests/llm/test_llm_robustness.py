"""Null rows, repeated rows, clashing column names and empty tables change nothing."""

import sys
from pathlib import Path

import pytest

pytest.importorskip("auditloom.llm")
sys.path.insert(0, str(Path(__file__).parent.parent))

from robust import copies, rows

from auditloom.llm import catalogue

CASES = {"p2_found": ["citation_trail", "records"], "p8_ids": ["documents"], "p9_draws": ["documents", "mix_targets"], "p10_found": ["documents", "name_lexicon"]}


@pytest.mark.parametrize("name", CASES)
def test_same_result(spark, tmp_path, name):
    # document ids are unique, so rows of documents aren't repeated
    plain, more, none = copies(spark, tmp_path, CASES[name], repeat="documents" not in CASES[name])
    q = catalogue.QUERIES[name]
    want, got = rows(q(spark, plain)), rows(q(spark, more))
    if name == "p8_ids":
        got = [r for r in got if "doc_id=None" not in r]
    assert want and got == want
    assert rows(q(spark, none)) == []
