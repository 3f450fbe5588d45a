"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from checks.catalogue import QUERIES
from checks.views import Views
from pacelake.functions import scalars as S
from pacelake.operators import ordering, reports, windows

SF = "/root/testdata/sf0.001"
LEARNED = {n for n in QUERIES if re.match(r"m\d", n)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LEARNED))
def test_no_cross_join_and_no_single_task_window(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "w5_sorted_by_time":
        assert not re.search(r"Exchange SinglePartition.*\n.*Window", text)
    assert not re.search(r"Window \[.*windowspecdefinition\((?!\w+#)", text)


def test_month_filter_reaches_the_scan(spark):
    df = Views(spark, SF).events.filter(S.in_month("ts", 2024, 1)).select("event_id")
    assert "GreaterThanOrEqual(ts" in plan(df) and "LessThan(ts" in plan(df)


def test_only_needed_columns_are_read(spark):
    text = plan(reports.workouts_per_sport(Views(spark, SF).sessions))
    assert re.search(r"ReadSchema: struct<event_type:string>", text)


def test_newest_rows_are_cut_before_the_shuffle(spark):
    v = Views(spark, SF)
    text = plan(ordering.newest_per_key(v.sessions, ["user_id"], "start_time", "activity_id", 5))
    shuffle = text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text[shuffle:]


def test_first_row_is_combined_before_the_shuffle(spark):
    v = Views(spark, SF)
    text = plan(ordering.first_per_key(v.daily, ["user_id", "calendar_date"], ["row_id"]))
    assert text.count("Aggregate(") >= 2 and text.count("Exchange hashpartitioning") == 1


def test_windows_join_on_athlete_and_chunk(spark):
    v = Views(spark, SF)
    text = plan(windows.training_windows(v.history, v.sessions, ["load"], n=20))
    assert re.search(r"Join \[user_id#\d+L, chunk#\d+L\]", text)


def test_elapsed_needs_no_window(spark):
    text = plan(reports.with_elapsed(Views(spark, SF).sessions, "start_time", ["user_id"]))
    assert "Window" not in text


def test_models_multiply_rows_without_join(spark):
    text = plan(QUERIES["j8_rows_per_model"](spark, SF))
    assert "Join" not in text and "Generate explode" in text


def test_split_groups_broadcast_only_slice_totals(spark):
    v = Views(spark, SF)
    text = plan(ordering.number_rows(v.history, ["user_id"], ["begin_ts", "row_id"], max_group_rows=0))
    assert text.count("BroadcastExchange") == 1
    assert F is not None
