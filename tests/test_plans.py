"""Plans: what reaches the scan, what stays one stage, what is broadcast."""

from pyspark.sql import functions as F
from kelpworks.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vector_top_is_a_bounded_top_k_over_two_columns(spark, sf_dir):
    text = plan(registry.queries()["vector_top"](spark, sf_dir))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(registry.queries()["listing_search"](spark, sf_dir))
    assert "EqualTo(o_orderstatus,O)" in text and "GreaterThanOrEqual(o_totalprice" in text
    assert "l_shipdate" not in text and "BroadcastHashJoin" in text


def test_latest_match_needs_no_sort_of_a_group(spark, sf_dir):
    assert "Window" not in plan(registry.queries()["latest_match"](spark, sf_dir))


def test_native_queries_run_no_python(spark, sf_dir):
    for name in ("hybrid_rrf", "nearby_places", "normal_forms", "line_classes", "context_build", "question_profiles"):
        assert "Python" not in plan(registry.queries()[name](spark, sf_dir)), name


def test_bounded_ranks_drop_rows_before_the_shuffle(spark, sf_dir):
    for name in ("multi_query", "quota_selection", "round_robin"):
        text = plan(registry.queries()[name](spark, sf_dir))
        assert "WindowGroupLimit" in text, name
    assert "Window" not in plan(registry.queries()["keep_if_any"](spark, sf_dir))


def test_own_products_are_taken_before_pairs_and_scoped_rows_are_dealt(spark, sf_dir):
    from kelpworks.operators.search import best_matches
    from kelpworks.plans.service import scoped_rows
    from kelpworks.plans.tables import table

    rows = table(spark, sf_dir, "embeddings")
    plan = best_matches(rows, F.col("vec_id") % 100 == 0)._jdf.queryExecution().analyzed().toString()
    pairs = [line for line in plan.split("\n") if "round(" in line]
    assert pairs and all(line.count("aggregate(zip_with") == 1 for line in pairs)
    assert "RepartitionByExpression [c_custkey" in scoped_rows(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
