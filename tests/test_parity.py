"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tonearm import plans

from .parity import compare
from .plan_scan import problems


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_sql(spark, con, sf_dir, name):
    status, rows, _, _ = compare(spark, con, name, sf_dir)
    assert status.startswith(("ok", "rows-only")), status
    assert rows >= 0


def test_only_trained_models_lack_sql():
    missing = set(plans.queries()) - set(plans.oracle_sql())
    assert missing == {"item_embedding_table", "tag_embedding_table", "als_recs"}


@pytest.mark.parametrize("name", ["itemknn_recommend", "affinity_scores", "popularity_recs", "impute_songs", "pareto_head"])
def test_no_row_pair_joins(spark, sf_dir, name):
    assert problems(plans.queries()[name](spark, sf_dir)) == []
