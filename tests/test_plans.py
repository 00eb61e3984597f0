"""Physical plans are the ones wanted: pruned scans, pushed filters, bounded tops."""

import os
import re

import pytest

from ledgerlark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "year_bounds")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp\w*>", text)
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan(spark, "dense_filtered")


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "fact_like_limit", "bm25_term_stats"])
def test_tops_are_taken_by_task(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["dedup_keep_first", "fact_dedup", "topk_per_group", "sig_cap"])
def test_group_limits_come_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["best_label", "longest_doc", "quality_score", "mode_anchor", "pivot_min"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


def test_bm25_explodes_no_corpus(spark):
    assert "Generate explode" not in plan(spark, "bm25_topk")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


#: Joins with the one row of a global aggregate: corpus statistics, least and largest value.
ONE_ROW = {"bm25_topk", "bm25_filtered", "bm25_scan", "rrf_fuse", "hybrid_blend", "hybrid_without_encoder", "candidate_pool", "minmax_zscore", "scores_fused", "evidence_mmr", "evidence_blocks", "citation_guard"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - ONE_ROW))
def test_no_nested_loop_join(spark, name):
    assert "NestedLoopJoin" not in plan(spark, name)


def test_search_reads_the_query_terms_only(spark):
    assert re.search(r"PushedFilters: \[In\(term, \[", plan(spark, "bm25_topk"))
