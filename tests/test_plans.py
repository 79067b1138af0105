"""What the physical plans have to show at any size."""

import os
import re

import pytest

from vantage.plans import catalogue, fixtures

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_used(spark):
    text = plan(catalogue.queries()["gt_words"](spark, DATA))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["doc_id:bigint,text:string"]
    items = fixtures.table(spark, DATA, "benchmark").select("item_id", "text")  # numbered and materialised before the words are joined
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(items)) == ["item_id:bigint,text:string"]
    text = plan(fixtures.vectors(spark, DATA).where("label = 3").select("vec_id"))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in text and "embedding" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["topk_windows", "nms_greedy", "first_hit"])
def test_groups_are_limited_early(spark, name):
    assert "WindowGroupLimit" in plan(catalogue.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["window_scores_raw", "topk_windows", "window_scores_pq", "first_hit", "average_precision", "sparse_dot", "block_gram", "relevant_boxes"])
def test_joins_have_keys(spark, name):
    assert "CartesianProduct" not in plan(catalogue.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["relevant_counts", "window_scores_raw", "window_scores_pq", "ovr_loss"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(catalogue.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["window_scores_raw", "window_scores_pq"])
def test_cells_join_templates_by_place_or_code(spark, name):
    """The one nested-loop join left is with the single row of the templates' frame, or with the codebook."""
    text = plan(catalogue.queries()[name](spark, DATA))
    assert re.search(r"HashJoin|SortMergeJoin", text)
    assert not re.search(r"NestedLoopJoin.*\(r#\d+ >=", text)
