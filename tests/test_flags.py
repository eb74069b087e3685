"""Known flag decisions; ``rand`` is 0.5 throughout."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import flag_specs, flags
from waymark.schemas import FLAG_SPECS
from waymark.sources import parse_flag_specs

NOW = 1_000_000
SPEC_ROW = ("name string, boolean boolean, rollout_start long, rollout_end long,"
            "conditions array<struct<property:string,comparator:string,value:string>>")


def specs_of(spark, **specs):
    """``name=(boolean, start, end, [(property, comparator, value)])``"""
    rows = [(name, b, s, e, [(p, c, json.dumps(v)) for p, c, v in conditions])
            for name, (b, s, e, conditions) in specs.items()]
    return spark.createDataFrame(rows, SPEC_ROW).select(
        "name", "boolean", "rollout_start", "rollout_end",
        F.transform("conditions", lambda c: F.struct(
            c["property"].alias("property"), c["comparator"].alias("comparator"),
            F.parse_json(c["value"]).alias("value"))).alias("user"))


def decide(spark, user, **specs):
    users = spark.createDataFrame([(1, json.dumps(user))], "id int, j string").select(
        "id", F.parse_json("j").alias("user"))
    rows = flags.flags_for_users(users, specs_of(spark, **specs), F.lit(NOW), F.lit(0.5),
                                 "id").collect()
    assert len(rows) == len(specs)
    return {r["name"]: r["enabled"] for r in rows}


def test_boolean_and_rollout(spark):
    assert decide(
        spark, {},
        off=(False, None, None, []), on=(True, None, None, []),
        later=(False, NOW + 10, NOW + 60, []), later_on=(True, NOW + 10, NOW + 60, []),
        third=(False, NOW - 5, NOW + 10, []), most=(False, NOW - 10, NOW + 5, []),
        over=(False, NOW - 60, NOW - 10, []), point=(False, NOW, NOW, []),
        no_end=(False, NOW - 60, None, []), no_start=(False, None, NOW - 60, []),
        half=(False, NOW - 5, NOW + 5, []),
    ) == {"off": False, "on": True, "later": False, "later_on": True, "third": False,
          "most": True, "over": True, "point": False, "no_end": False, "no_start": False,
          "half": True}


def test_user_conditions(spark):
    def when(comparator, value, boolean=False):
        return (boolean, None, None, [("user_id", comparator, value)])

    assert decide(
        spark, {"user_id": 42},
        same=when("=", 42), decimal=when("=", 42.0), other=when("=", 24),
        other_on=when("=", 24, True), text=when("=", "42"), listed=when("in", [41, 42, 43]),
        unlisted=when("in", [0, 1, 2]), texts=when("in", ["42"]), decimals=when("in", [42.0]),
        either=(False, None, None, [("user_id", "=", 24), ("user_id", "=", 42)]),
        neither=(False, None, None, [("user_id", "=", 1), ("user_id", "=", 2)]),
        absent=(False, None, None, [("other", "=", 42)]),
    ) == {"same": True, "decimal": True, "other": False, "other_on": True, "text": False,
          "listed": True, "unlisted": False, "texts": False, "decimals": False,
          "either": True, "neither": False, "absent": False}


def test_text_conditions(spark):
    assert decide(
        spark, {"user_id": "42", "odd name.x": True, "big": 9007199254740993},
        same=(False, None, None, [("user_id", "=", "42")]),
        number=(False, None, None, [("user_id", "=", 42)]),
        listed=(False, None, None, [("user_id", "in", ["40", "41", "42"])]),
        odd=(False, None, None, [("odd name.x", "=", True)]),
        big=(False, None, None, [("big", "=", 9007199254740992)]),
    ) == {"same": True, "number": False, "listed": True, "odd": True, "big": False}


def test_condition_comes_before_rollout(spark):
    spec = (False, NOW + 10, NOW + 60, [("user_id", "=", 42)])
    assert decide(spark, {"user_id": 42}, f=spec) == {"f": True}
    assert decide(spark, {"user_id": 7}, f=spec) == {"f": False}


def test_no_specs_give_no_flags(spark):
    users = spark.createDataFrame([(1, "{}")], "id int, j string").select(
        "id", F.parse_json("j").alias("user"))
    found = flags.flags_for_users(users, spark.createDataFrame([], FLAG_SPECS), F.lit(NOW),
                                  F.lit(0.5), "id")
    assert found.collect() == []


def test_a_long_allow_list_is_looked_up(spark):
    """100,000 members in one condition: members are rows, each user meets one of them."""
    specs = specs_of(spark, f=(False, None, None, [("user_id", "in", list(range(100_000)))]))
    users = spark.range(99_990, 100_010).select("id", F.parse_json(F.concat(
        F.lit('{"user_id": '), F.col("id").cast("string"), F.lit("}"))).alias("user"))
    rows = flags.flags_for_users(users, specs, F.lit(NOW), F.lit(0.5), "id").collect()
    assert {r["id"]: r["enabled"] for r in rows} == {
        i: i < 100_000 for i in range(99_990, 100_010)}


def test_exposure_grows_evenly(spark):
    rows = flags.rollout_exposure(specs_of(spark, f=(False, 0, 40, [])), 10).collect()
    assert [(r["at"], r["chance"]) for r in rows] == [
        (0, 0.0), (10, 0.25), (20, 0.5), (30, 0.75), (40, 1.0)]


def test_invalid_specs(spark):
    specs = spark.createDataFrame(
        [("a", 1, None, []), ("b", 2, 1, []), ("c", None, 1, []), ("d", 1, 1, []),
         ("e", None, None, [["user_id", "like", "x"]]), ("f", None, None, [["user_id", "="]]),
         ("g", None, None, [["user_id", "in", "x"]])],
        "name string, rollout_start long, rollout_end long, user array<array<string>>")
    assert {r["name"] for r in flag_specs.spec_rejects(specs).collect()} == set("abcef")


@pytest.mark.parametrize("text, value", [
    ("enabled", True), ("true", True), ("disabled", False), ("false", False),
    ("undefined", False), (None, False), ("junk", None)])
def test_boolean_texts(spark, text, value):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(flag_specs.boolean_from_text(F.col("t"))).first()[0] is value


def test_last_update_wins(spark):
    updates = spark.createDataFrame(
        [("f", 1, True, 5), ("f", 3, False, None), ("f", 2, True, 7), ("g", 1, True, 1)],
        "name string, seq long, boolean boolean, rollout_start long")
    found = {r["name"]: tuple(r)[1:] for r in flag_specs.upsert_specs(updates).collect()}
    assert found == {"f": (3, False, None), "g": (1, True, 1)}


def test_specs_are_parsed_and_rendered(spark):
    body = {"name": "f", "rollout_start": "2024-01-01T00:00:00Z",
            "rollout_end": "2024-01-01T02:00:00+01:00",
            "user": [{"property": "id", "comparator": "in", "value": [1, 2]},
                     {"property": "id", "comparator": "=", "value": "x"}]}
    parsed = parse_flag_specs(spark.createDataFrame([(json.dumps(body),)], "body string"))
    row = parsed.first()
    assert (row["reason"], row["boolean"]) == (None, False)
    assert row["rollout_end"] - row["rollout_start"] == 3600
    document = json.loads(flag_specs.render_specs(parsed).first()["document"])
    assert document == {**body, "boolean": False, "rollout_end": "2024-01-01T01:00:00Z"}
    bare = parse_flag_specs(spark.createDataFrame([('{"name":"f"}',)], "body string"))
    assert json.loads(flag_specs.render_specs(bare).first()["document"]) == {
        "name": "f", "boolean": False, "user": []}


@pytest.mark.parametrize("body, reason", [
    ('{"boolean": true}', "missing_required_key"),
    ('{"name": 3}', "incorrect_type"),
    ('{"name": "f", "boolean": "yes"}', "incorrect_type"),
    ('{"name": "f", "rollout_start": "2020"}', "invalid_date"),
    ('{"name": "f", "user": [{"property": "p", "comparator": "<", "value": 1}]}',
     "invalid_condition"),
    ('{"name": "f", "user": [{"property": "p", "comparator": "in", "value": [1, "a"]}]}',
     "invalid_condition"),
    ('{"name": "f", "user": [{"property": "p", "comparator": "="}]}', "invalid_condition"),
    ('{"name": "f", "user": 3}', "incorrect_type"),
    ('[1]', "invalid_json"), ('{', "invalid_json"),
])
def test_unusable_spec_bodies(spark, body, reason):
    parsed = parse_flag_specs(spark.createDataFrame([(body,)], "body string"))
    assert parsed.first()["reason"] == reason


def test_names_are_listed_without_regard_to_case(spark):
    frame = spark.createDataFrame([("b",), ("A",), ("c",), ("B",)], "name string")
    assert [r["name"] for r in flag_specs.list_specs(frame).collect()] == ["A", "B", "b", "c"]
