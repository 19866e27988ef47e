import pytest
from pyspark.sql import functions as F

from tidewire.functions import filters

# include, regex, exclude, {topic: kept}
CASES = {
    "a name is compared whole, with case and slashes": (["/lidar/front"], False, "", {"/lidar/front": True, "/lidar/Front": False, "lidar/front": False, "/lidar/front/raw": False}),
    "several names": (["/a", "/b"], False, "", {"/a": True, "/b": True, "/c": False}),
    "signs of patterns mean nothing in names": (["/wheel.*"], False, "", {"/wheel.*": True, "/wheel_left": False}),
    "patterns match whole names": (["/wheel_(left|right)"], True, "", {"/wheel_left": True, "/wheel_left/speed": False, "/my/wheel_left": False}),
    "anchors may be spelled out": (["^/odom$"], True, "", {"/odom": True, "/odom2": False}),
    "any of several patterns": (["/gps/.+", ".*_raw"], True, "", {"/gps/fix": True, "/cam_raw": True, "/gps/": False}),
    "alternatives stay inside their pattern": (["x|yz"], True, "", {"x": True, "yz": True, "xz": False}),
    "a line end is a character": (["/pose"], True, "", {"/pose": True, "/pose\n": False}),
    "no names keep all but the excluded": ([], False, "/diag/.*", {"/pose": True, "": True, "/diag/cpu": False, "/a/diag/cpu": True}),
    "exclusion wins": (["/diag/cpu", "/pose"], False, "/diag/.*", {"/diag/cpu": False, "/pose": True}),
    "the empty name is a name": ([""], False, "", {"": True, "/pose": False}),
}


@pytest.mark.parametrize("case", CASES)
def test_topic_filter(spark, case):
    include, regex, exclude, topics = CASES[case]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    rows = df.select("topic", filters.topic_filter(include, regex=regex, exclude=exclude).alias("kept")).collect()
    assert {r.topic: r.kept for r in rows} == topics


def test_system_and_builtin_topics(spark):
    df = spark.createDataFrame([("",), ("DCPSTopic",), ("rt/x",), ("/a",), (None,), ("xDCPS",)], "topic string")

    def kept(predicate):
        return {r.topic for r in df.where(predicate).collect()}

    assert kept(filters.not_system()) == {"/a", "xDCPS"}
    assert kept(filters.not_builtin()) == {"", "rt/x", "/a", "xDCPS"}


def test_time_range(spark):
    df = spark.range(10).withColumnRenamed("id", "log_time_ns")
    assert [r[0] for r in filters.time_range(df, 3, 5).collect()] == [3, 4]
    assert filters.time_range(df, 3, 3).count() == 0
    last = spark.createDataFrame([(2**63 - 1,)], "log_time_ns bigint")
    assert filters.time_range(last).count() == 1 and filters.time_range(last, end=2**63 - 1).count() == 0
    with pytest.raises(ValueError):
        filters.time_range(df, 5, 3)


def test_participant_filters(spark):
    df = spark.createDataFrame([("a", ["/cam/1"], []), ("b", [], ["/cam/2"]), ("c", ["/imu"], None), ("d", None, None)],
                               "guid string, pub_topics array<string>, sub_topics array<string>")
    assert {r.guid for r in filters.by_topic_substring(df, "cam").collect()} == {"a", "b"}
    assert filters.by_topic_substring(df, "").count() == 4
    assert {r.guid for r in filters.exclude_guid(df, "a").collect()} == {"b", "c", "d"}
    assert filters.exclude_guid(df, "a", show_self=True).count() == 4


def test_payload_guard(spark):
    df = spark.createDataFrame([(b"1234",), (b"12345",), (b"",), (None,)], "payload binary")
    assert [bytes(r.payload) for r in df.where(filters.has_payload()).collect()] == [b"12345"]
    valid = spark.createDataFrame([(True, True), (True, False), (False, True)], "valid boolean, alive boolean")
    assert filters.valid_only(valid).count() == 2
    assert filters.alive_only(valid).count() == 1
    assert filters.alive_only(valid.select("alive")).count() == 2
    assert valid.where(F.col("alive")).count() == 2
