"""Reading events, requests and files."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from waymark.functions.dates import format_rfc3339, iso_week, iso_year
from waymark.sources import (accepted_events, events_from_lines, parse_flag_requests,
                             parse_requests, read_event_files, rejected_requests,
                             usage_events, wide_to_events)
from waymark.sources.event_requests import packed_seq
from waymark.sources.wide import Pass

EVENT = {"event_name": "e", "user_id": "u"}


def parsed(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return parse_requests(spark.createDataFrame(rows, "request_seq long, body string"))


def test_three_shapes_keep_their_order(spark):
    second = {**EVENT, "event_name": "f", "namespace": "n", "value": 1, "ensure_goal": True,
              "datetime": "2021-01-03T23:30:00-02:00"}
    log = accepted_events(parsed(spark, EVENT, {"events": [EVENT, second]}, [second, EVENT]))
    rows = log.orderBy("seq").collect()
    assert [(r["request_seq"], r["pos"], r["shape"], r["event_name"]) for r in rows] == [
        (0, 0, "single", "e"), (1, 0, "envelope", "e"), (1, 1, "envelope", "f"),
        (2, 0, "array", "f"), (2, 1, "array", "e")]
    full = rows[2]
    assert (full["namespace"], full["value"], full["ensure_goal"]) == ("n", 1.0, True)
    assert (full["iso_year"], full["iso_week"]) == (2021, 1)  # already Monday in UTC
    plain = rows[0]
    assert (plain["namespace"], plain["value"], plain["ensure_goal"]) == ("default", None, False)


@pytest.mark.parametrize("body, reason", [
    ({**EVENT, "datetime": "invalid datetime"}, "invalid_date"),
    ({**EVENT, "datetime": "2020"}, "invalid_date"),
    ({**EVENT, "datetime": "2020-01-01"}, "invalid_date"),
    ({**EVENT, "datetime": "2020-13-01T00:00:00Z"}, "invalid_date"),
    ({**EVENT, "value": "foo"}, "incorrect_type"),
    ({**EVENT, "user_id": 42}, "incorrect_type"),
    ({**EVENT, "namespace": None}, "incorrect_type"),
    ({**EVENT, "ensure_goal": "yes"}, "incorrect_type"),
    ({"event_name": "e"}, "missing_required_key"),
    ({"user_id": "u"}, "missing_required_key"),
    ({**EVENT, "events": [EVENT]}, "matches_more_than_one_shape"),
    ({"events": [EVENT, {"event": "e", "user_id": "u"}]}, "missing_required_key"),
    ([EVENT, 3], "incorrect_type"),
    ({"events": 3}, "incorrect_type"),
    ("3", "incorrect_type"),
    ("{", "invalid_json"),
])
def test_rejects(spark, body, reason):
    requests = parsed(spark, body)
    assert [r["reason"] for r in rejected_requests(requests).collect()] == [reason]
    assert accepted_events(requests).count() == 0


@pytest.mark.parametrize("body", [[], {"events": []}, {**EVENT, "extra": {"a": 1}},
                                  {**EVENT, "value": 1.1}, {**EVENT, "value": 1},
                                  {**EVENT, "datetime": "2020-01-02t03:04:05.678z"}])
def test_accepted(spark, body):
    assert rejected_requests(parsed(spark, body)).count() == 0


def test_one_bad_event_rejects_only_its_request(spark):
    requests = parsed(spark, [EVENT, {}], [EVENT, EVENT])
    assert [r["request_seq"] for r in rejected_requests(requests).collect()] == [0]
    assert accepted_events(requests).count() == 2


def test_order_numbers_that_do_not_fit_fail(spark):
    frame = spark.createDataFrame([(1, 1 << 24)], "r long, p long")
    with pytest.raises(Exception, match="out of range"):
        frame.select(packed_seq(F.col("r"), F.col("p"))).collect()


@pytest.mark.parametrize("day, expected", [
    ("2021-01-03", (2020, 53)), ("2000-01-03", (2000, 1)), ("2000-01-01", (1999, 52)),
    ("2024-12-30", (2025, 1))])
def test_iso_weeks(spark, day, expected):
    frame = spark.createDataFrame([(day,)], "d string").select(F.to_date("d").alias("d"))
    assert tuple(frame.select(iso_year(F.col("d")), iso_week(F.col("d"))).first()) == expected


def test_lines_split_at_the_first_comma(spark):
    lines = spark.createDataFrame(
        [(1, " u , a,b "), (2, "no comma"), (3, "v,"), (4, ",x")], "seq long, value string")
    rows = events_from_lines(lines, event_prefix="p:", goal=True).orderBy("seq").collect()
    assert [(r["user_id"], r["event_name"]) for r in rows] == [
        ("u", "p:a,b"), ("v", "p:"), ("", "p:x")]
    assert all(r["ensure_goal"] and r["namespace"] == "default" for r in rows)


def test_files_are_read_in_order_over_many_splits(spark, tmp_path):
    number = 0
    for name, count in (("a.csv", 4000), ("b.csv", 50), ("c.csv", 3000)):
        lines = []
        for _ in range(count):
            lines.append(f"user{number},event{number}")
            number += 1
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    session.conf.set("spark.sql.files.openCostInBytes", "10")
    log = read_event_files(session, str(tmp_path))
    assert log.rdd.getNumPartitions() > 3
    rows = log.orderBy("seq").collect()
    assert [r["event_name"] for r in rows] == [f"event{i}" for i in range(number)]
    assert len({r["seq"] for r in rows}) == number


def test_wide_rows_arrive_pass_by_pass(spark):
    table = spark.createDataFrame([(7, "z1", "open"), (8, None, "closed")],
                                  "id long, zip string, status string")
    rows = wide_to_events(table, "id", "id", [Pass("zip", "zip:"),
                                              Pass("status", "status:", goal=True)])
    assert [(r["user_id"], r["event_name"], r["ensure_goal"])
            for r in rows.orderBy("seq").collect()] == [
        ("7", "zip:z1", False), ("7", "status:open", True), ("8", "status:closed", True)]


def encoded(value):
    text = value if isinstance(value, str) else json.dumps(value)
    return base64.b64encode(text.encode()).decode()


def test_flag_requests(spark):
    rows = [
        (1, encoded({"user_id": "u"}), encoded({"feature": "f"})),
        (2, encoded({"user_id": 42}), encoded({"feature": "f"})),
        (3, encoded({"name": "n"}), encoded({"feature": "f"})),
        (4, encoded({"user_id": "u"}), None),
        (5, "not base64!", None),
        (6, encoded("{bad"), None),
    ]
    requests = parse_flag_requests(spark.createDataFrame(
        rows, "seq long, user_obj string, context_obj string"))
    assert {r["seq"]: r["reason"] for r in requests.collect()} == {
        1: None, 2: None, 3: None, 4: None, 5: "invalid_base64", 6: "invalid_json"}
    events = {(r["seq"], r["namespace"], r["event_name"], r["user_id"])
              for r in usage_events(requests).collect()}
    assert events == {(1, "default", "f", "u"), (2, "default", "f", "42")}


def test_the_session_time_zone_does_not_matter(spark):
    """Weeks and texts are in UTC, also for a session elsewhere."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    requests = session.createDataFrame(
        [(0, json.dumps({**EVENT, "datetime": "2024-01-08T00:30:00Z"})),
         (1, json.dumps({**EVENT, "datetime": "2024-01-07T23:30:00Z"})), (2, json.dumps(EVENT))],
        "request_seq long, body string").withColumn(
        "at", F.lit("2024-01-08 00:30:00").cast("timestamp_ntz"))
    log = accepted_events(parse_requests(requests), received_at="at").orderBy("seq")
    assert [r["iso_week"] for r in log.collect()] == [2, 1, 2]
    text = session.range(1).select(format_rfc3339(F.lit(1_704_067_200)).alias("t"))
    assert text.first()["t"] == "2024-01-01T00:00:00Z"
