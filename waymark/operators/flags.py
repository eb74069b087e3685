"""Feature flags: boolean, user conditions, timed rollout, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.variants import equality_key, let, member_key

EQUALS, MEMBER_OF = "=", "in"


def user_keys(user: Column) -> Column:
    """Comparison keys of a user object (VARIANT), computed once for all conditions."""
    properties = F.try_variant_get(user, "$", "map<string,variant>")
    return let(properties, lambda p: F.struct(
        F.transform_values(p, lambda _, v: equality_key(v)).alias("equality"),
        F.transform_values(p, lambda _, v: member_key(v)).alias("member")))


def condition_keys(condition: Column) -> Column:
    """A ``property comparator value`` condition with its value as comparison keys."""
    items = F.try_variant_get(condition["value"], "$", "array<variant>")
    return F.struct(
        condition["property"].alias("property"),
        F.when(condition["comparator"] == EQUALS, equality_key(condition["value"]))
        .alias("equality"),
        F.when(condition["comparator"] == MEMBER_OF, F.transform(items, member_key))
        .alias("members"))


def condition_holds(keyed: Column, user: Column) -> Column:
    """A condition from :func:`condition_keys` for a user from :func:`user_keys`.

    An absent property has no key and matches nothing.
    """
    equal = F.try_element_at(user["equality"], keyed["property"]) == keyed["equality"]
    member = F.array_contains(keyed["members"],
                              F.try_element_at(user["member"], keyed["property"]))
    return F.coalesce(equal, member, F.lit(False))


def any_condition_holds(keyed: Column, user: Column) -> Column:
    return F.coalesce(F.exists(keyed, lambda c: condition_holds(c, user)), F.lit(False))


def rollout_chance(start: Column, end: Column, now: Column) -> Column:
    """Share of the rollout that is over: 0 up to its start, 1 from its end on."""
    return (F.when(start.isNull() | end.isNull() | (now <= start), F.lit(0.0))
            .when(now >= end, F.lit(1.0))
            .otherwise((now - start) / (end - start)))


def rollout_on(start: Column, end: Column, now: Column, rand: Column) -> Column:
    """An incomplete rollout is off; during one, ``rand`` is compared with its progress."""
    return (F.when(start.isNull() | end.isNull() | (now <= start), F.lit(False))
            .when(now >= end, F.lit(True))
            .otherwise(rand <= (now - start) / (end - start)))


def keyed_spec(spec: Column) -> Column:
    """A spec with its user conditions prepared for comparison."""
    return spec.withField("user", F.transform(spec["user"], condition_keys))


def flag_value(spec: Column, user: Column, now: Column, rand: Column) -> Column:
    """Decision of a :func:`keyed_spec` for :func:`user_keys`."""
    return (F.coalesce(spec["boolean"], F.lit(False))
            | any_condition_holds(spec["user"], user)
            | rollout_on(spec["rollout_start"], spec["rollout_end"], now, rand))


def condition_rows(specs: DataFrame) -> DataFrame:
    """``(name, property, comparator, value)``: what a user's property has to be. Every member
    of an allow-list is a row, so a long list is looked up like a table."""
    conditions = specs.select("name", F.explode("user").alias("c"))
    equal = conditions.filter(F.col("c.comparator") == EQUALS).select(
        "name", F.col("c.property").alias("property"), F.lit(EQUALS).alias("comparator"),
        equality_key(F.col("c.value")).alias("value"))
    listed = conditions.filter(F.col("c.comparator") == MEMBER_OF).select(
        "name", F.col("c.property").alias("property"),
        F.explode(F.try_variant_get("c.value", "$", "array<variant>")).alias("item"))
    members = listed.select("name", "property", F.lit(MEMBER_OF).alias("comparator"),
                            member_key(F.col("item")).alias("value"))
    return equal.unionByName(members).distinct()


def property_rows(users: DataFrame, key: str, user: str = "user") -> DataFrame:
    """``(key, property, comparator, value)``: every property of a user in both ways of
    comparing."""
    properties = users.select(key, F.explode(
        F.try_variant_get(F.col(user), "$", "map<string,variant>")).alias("property", "v"))
    both = F.array(
        F.struct(F.lit(EQUALS).alias("comparator"), equality_key(F.col("v")).alias("value")),
        F.struct(F.lit(MEMBER_OF).alias("comparator"), member_key(F.col("v")).alias("value")))
    return properties.select(key, "property", F.explode(both).alias("b")).select(
        key, "property", "b.*")


def flags_for_users(users: DataFrame, specs: DataFrame, now: Column, rand: Column, key: str,
                    user: str = "user") -> DataFrame:
    """``(key, name, enabled)``: every flag's value for each user; ``key`` names users.

    Specs stay rows. Conditions meet the users' properties by an equi-join on property and
    value, which adaptive execution broadcasts or splits by its size. Only the names and
    rollout bounds are paired with all users, since user times flag is the result.
    """
    lookup = ["property", "comparator", "value"]
    matched = (property_rows(users, key, user).join(condition_rows(specs), lookup)
               .select(key, "name").distinct().withColumn("_matched", F.lit(True)))
    bounds = specs.select("name", "boolean", "rollout_start", "rollout_end")
    paired = users.select(key, rand.alias("_rand")).crossJoin(bounds)
    decided = paired.join(matched, [key, "name"], "left")
    return decided.select(key, "name", (
        F.coalesce("boolean", F.lit(False)) | F.coalesce("_matched", F.lit(False))
        | rollout_on(F.col("rollout_start"), F.col("rollout_end"), now, F.col("_rand")))
        .alias("enabled"))


STEPS = 1000  # instants of a rollout listed together


def rollout_exposure(specs: DataFrame, step_seconds: int) -> DataFrame:
    """Expected share of enabled users at equal steps through each rollout.

    Instants are made in two steps, so that no cell holds those of a whole rollout.
    """
    step, width = F.lit(step_seconds).cast("long"), F.lit(step_seconds * STEPS).cast("long")
    chunks = F.sequence("rollout_start", "rollout_end", width)
    instants = F.sequence("_from", F.least(F.col("_from") + width - step, "rollout_end"), step)
    return (specs.filter(F.col("rollout_start") <= F.col("rollout_end"))
            .select("name", "rollout_start", "rollout_end", F.explode(chunks).alias("_from"))
            .select("name", "rollout_start", "rollout_end", F.explode(instants).alias("at"))
            .select("name", "at", rollout_chance(
                F.col("rollout_start"), F.col("rollout_end"), F.col("at")).alias("chance")))
