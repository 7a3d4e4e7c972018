"""Physical plans: pushdown, pruning, early top-k, no pairing of whole tables."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyword, metrics
from tidemark.operators.chunking import chunk
from tidemark.queries import all_queries
from tidemark.session import materialize


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, column", [("p10_lookup", "doc_id"), ("p3_nested_equality", "o_orderstatus"), ("sc10_load_split", None)])
def test_filters_reach_the_scan(spark, sf_dir, name, column):
    plan = plan_of(all_queries()[name](spark, sf_dir))
    if column is None:
        assert re.search(r"PartitionFilters: \[.*task.*split", plan)
    elif name == "p10_lookup":
        assert f"EqualTo({column},42)" in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(all_queries()["w1_top_k_per_key"](spark, sf_dir))
    assert "l_shipdate" not in plan and "l_tax" not in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(all_queries()["w1_top_k_per_key"](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["a7_roc_auc", "w3_curve_points", "j2_left_join_dim", "w5_uct", "f4_coerce", "r5_search_keyword"])
def test_no_cartesian_products(spark, sf_dir, name):
    plan = plan_of(all_queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scores_are_not_sorted_in_one_partition(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") / 7).alias("prob"))
    plan = plan_of(metrics.curve_points(df, ranges=5))
    for line in plan.splitlines():
        if "Window" in line and "score" in line:
            assert "bucket" in line


def test_pairs_of_query_and_chunk_do_not_shuffle(spark, sf_dir):
    """Above the scored pairs of the postings search there is one exchange: that of the final top-k."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("2000-01-01").cast("date").alias("doc_date"), "text")
    queries = spark.createDataFrame([(1, None, "the and"), (2, None, "of")], "query_id int, as_of date, text string")
    tokens = materialize(keyword.token_table(chunk(docs, "text")), "tokens")
    index = keyword.KeywordIndex(tokens, materialize(keyword.build_postings(tokens), "postings"))
    plan = plan_of(keyword.search_postings(queries, index, 5))
    main = plan.split("Subqueries")[0]
    above_join = main.split("BroadcastHashJoin")[0]
    assert above_join.count("Exchange hashpartitioning") == 1
