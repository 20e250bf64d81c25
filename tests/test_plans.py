"""Physical-plan shape checks."""

import __spark_entry__ as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_lookup_is_equi_join(spark, sf):
    p = plan(E.queries()["audit_by_patient"](spark, sf))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_trend_filter_pushed_to_scan(spark, sf):
    p = E.queries()["visit_trend_7d"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p


def test_grouped_top_k_is_limited_before_shuffle(spark, sf):
    p = plan(E.queries()["follow_up_reminders"](spark, sf))
    assert "WindowGroupLimit" in p


def test_keep_first_is_partial_aggregate(spark, sf):
    p = plan(E.queries()["dedup_phone"](spark, sf))
    assert "partial_min_by" in p


def test_no_query_plans_a_cross_or_nested_loop_join(spark, sf):
    streams = {"replay_pending", "upload_stream"}
    for name, fn in E.queries().items():
        if name in streams:
            continue
        p = plan(fn(spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
