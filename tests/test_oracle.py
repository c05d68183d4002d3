"""A fast part of the two-engine check; tests/check_oracle.py runs all of it."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
FAST = ["review_projection", "dedupe_audit", "theme_matches", "display_name", "structured_tokens", "product_evidence",
        "class_report", "parse_cards", "url_scores", "contradictions_top3"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_same_rows_on_both_engines(spark, name):
    assert compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) == ""
