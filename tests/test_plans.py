"""Plans are those meant for large data: no cross joins, no row-at-a-time Python, pruned and filtered scans."""

import re

import pytest

from millrace import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cross_join_and_no_row_udf(spark, data, name):
    p = plan(registry.queries()[name](spark, data))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", p)


@pytest.mark.parametrize(
    "name,columns,pushed",
    [
        ("scan_search", {"id", "function_name", "updated_at", "language", "project"}, ["EqualTo(language,c)", "EqualTo(project,hexwire)"]),
        ("top_called", {"id", "code"}, []),
        ("agg_status", {"conversion_type", "status"}, []),
        ("fn_token_estimate", {"doc_id", "text"}, []),
        ("html_source_type", {"page_id", "url"}, []),
        ("chunk_lines", {"id", "code"}, ["IsNotNull(code)"]),
    ],
)
def test_scans_are_pruned(spark, data, name, columns, pushed):
    p = plan(registry.queries()[name](spark, data))
    read = re.findall(r"ReadSchema: struct<(.*)>", p)
    assert read and all({c.split(":")[0] for c in r.split(",")} <= columns for r in read)
    assert all(x in p for x in pushed)


def test_top_k_keeps_k_rows_a_task(spark, data):
    assert "TakeOrderedAndProject" in plan(registry.queries()["top_newest"](spark, data))
    assert "WindowGroupLimit" in plan(registry.queries()["window_recent"](spark, data))
