"""Plans of the registered queries: no Python on the engine's paths, no all-pairs joins, scans that prune and push down."""

from __future__ import annotations

from pathlib import Path

import pytest
from tabulon import queries as catalogue
from tabulon import queries_rules  # noqa: F401
from tabulon.plans import inspect

DATA = "/root/testdata/sf0.001"
#: Queries whose plan is worth holding: lazy ones over large tables.
LAZY = (
    "filter_expr_and_or", "filter_in", "view_where_chain", "computed_arith", "json_path", "groupby_multi", "join_inner_on", "join_fn_composite", "distinct_first_wins",
    "union_all_by_name", "sort_multi_topk", "tracking_changes", "changeset_changed_columns", "merge_preserve", "merge_duplicate_keys", "apply_changeset", "fk_orphans",
)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the generated tables")
@pytest.mark.parametrize("name", LAZY)
def test_plan(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert not inspect.in_python(df) and not inspect.all_pairs(df), inspect.physical(df)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the generated tables")
def test_scans_prune_and_push_down(spark):
    df = catalogue.QUERIES["filter_expr_and_or"](spark, DATA)
    assert any("GreaterThanOrEqual(l_quantity" in x for x in inspect.pushed_filters(df))
    assert inspect.read_columns(df) == [["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]] and inspect.exchanges(df) == 0
    assert inspect.in_python(catalogue.QUERIES["filter_python_predicate"](spark, DATA))
