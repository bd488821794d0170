"""Every registered query with SQL text equals DuckDB on the smallest data set."""
import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
MAY_BE_EMPTY = {"full_days", "unique_audit", "standby_notices", "topm_matched", "evenly_spaced"}  # too few rows at this scale


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    problem = compare(con, entry.queries()[name](spark, SF), SQL[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", ["patient_history", "standby_board", "transition_audit", "queue_timeline", "every_kth", "topm_matched",
                                  "positional_join", "grouped_folds", "stratified_folds", "binary_metrics", "reliability_quantile",
                                  "bootstrap_ci", "failure_window", "best_f1_threshold", "score_whatif"])
def test_query_equals_sql_with_large_groups_cut(spark, con, cut_groups, name):
    """The same answers when every group above twenty rows takes the path for huge groups."""
    problem = compare(con, entry.queries()[name](spark, SF), SQL[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
