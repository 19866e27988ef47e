"""Plans of the registered queries: nothing quadratic, narrow scans, no hot key in one task."""

import pytest

import tests.support.derived  # noqa: F401  (queries over encoded inputs)
from tidewire.plans import QUERIES

# these run jobs (streams, writers, loops) before they return a plan
EAGER = {"record_live_dims", "stop_live", "retain_live", "compression", "late_data", "pause_resume", "splits_going_on", "bounded_run", "progress", "tick", "for_each_batch", "hz_live", "endpoints_live", "record_live", "split_live", "write_recording", "splits_union", "written_dims",
         "type_dependencies", "decode_by_topic", "read_mcap", "summary_mcap", "hz_from_files", "messages_from_files", "dims_from_files"}


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_nothing_quadratic_or_single_task(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in ("recording_stats", "participant_count"):  # one row by definition
        assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["hz_stats", "monotone", "intervals", "rolling_hz", "hz_reports"])
def test_rates_never_read_payloads(spark, sf_dir, name):
    assert "props" not in plan_of(spark, sf_dir, name)


def test_last_n_is_trimmed_before_the_shuffle(spark, sf_dir):
    assert "row_number(), 30, Partial" in plan_of(spark, sf_dir, "last_n")


def test_first_n_takes_ordered_without_a_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(spark, sf_dir, "first_n")


@pytest.mark.parametrize("name", ["topic_list", "live_endpoints", "type_catalog", "topic_types", "scan_participants", "assign_ids"])
def test_announcements_collapse_by_hashing_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    first_stage = plan.rstrip().split("Exchange")[-1]
    assert "HashAggregate" in first_stage and "SortAggregate" not in first_stage
