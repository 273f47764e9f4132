"""Registered queries beside their SQL twins on the smallest tables; every plan at least builds."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
CHECKED = ("price_index", "rare_index", "week_before", "mention_stats", "title_levels", "archive_new", "listing_summary",
           "crowd_prices", "portfolio", "text_forms", "group_roots", "dictionary_matches", "stream_mention_counts")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["site", "period", "index_value", "compared"]


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 90
