"""Registered queries: feature flags. Customers are the users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.operators import flag_specs, flags
from waymark.plans.event_queries import parsed_specs, rounded
from waymark.plans.inputs import table
from waymark.schemas import FLAG_SPECS

NOW = 1_704_585_600  # 2024-01-07T00:00:00Z
DAY = 86_400


def now() -> Column:
    return F.lit(NOW).cast("long")


def rand() -> Column:
    """A fixed draw per user, so that results can be compared."""
    return (F.col("c_custkey") * 7919 % 1000) / 1000.0


def user_object() -> Column:
    return F.parse_json(F.to_json(F.struct(
        F.col("c_custkey").alias("user_id"),
        F.col("c_custkey").cast("string").alias("user_text"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("nation"))))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("user", user_object())


def _condition(prop: str, comparator: str, value: str) -> Column:
    return F.struct(F.lit(prop).alias("property"), F.lit(comparator).alias("comparator"),
                    F.parse_json(F.lit(value)).alias("value"))


def _keys() -> Column:
    return flags.user_keys(F.col("user"))


def _holds(prop: str, comparator: str, value: str) -> Column:
    keyed = flags.condition_keys(_condition(prop, comparator, value))
    return flags.condition_holds(keyed, F.col("keys"))


def flag_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boolean rule alone: one spec per part, no user, no rollout."""
    specs = parsed_specs(spark, sf_dir).filter(F.col("reason").isNull())
    spec = F.struct("name", "boolean", F.lit(None).cast("long").alias("rollout_start"),
                    F.lit(None).cast("long").alias("rollout_end"), "user")
    nobody = flags.user_keys(F.parse_json(F.lit("{}")))
    return specs.select("p_partkey", flags.flag_value(
        flags.keyed_spec(spec), nobody, now(), F.lit(0.5)).alias("enabled"))


def flag_user_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).withColumn("keys", _keys()).select(
        "c_custkey",
        _holds("segment", "=", '"BUILDING"').alias("segment_is"),
        _holds("nation", "=", "7").alias("nation_is"),
        _holds("nation", "=", "7.0").alias("nation_is_decimal"),
        _holds("nation", "=", '"7"').alias("nation_is_text"),
        _holds("absent", "=", "7").alias("absent_is"))


def flag_user_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).withColumn("keys", _keys()).select(
        "c_custkey",
        _holds("nation", "in", "[5, 6, 7]").alias("nation_in"),
        _holds("nation", "in", '["5", "6", "7"]').alias("nation_in_texts"),
        _holds("user_text", "in", '["40", "41", "42"]').alias("text_in"),
        _holds("segment", "in", '["BUILDING", "MACHINERY"]').alias("segment_in"))


def flag_user_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = F.array(_condition("segment", "=", '"BUILDING"'),
                     _condition("nation", "in", "[8, 9]"))
    keyed = F.transform(either, flags.condition_keys)
    return customers(spark, sf_dir).select(
        "c_custkey", flags.any_condition_holds(keyed, _keys()).alias("enabled"))


def flag_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollout per customer, its bounds taken from the account balance."""
    start = now() + F.floor("c_acctbal").cast("long") - 4_000
    end = F.when(F.col("c_nationkey") != 0, start + 100 * F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", flags.rollout_on(start, end, now(), rand()).alias("enabled"))


def nation_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec per nation: on in one region, for its own users, or rolled out."""
    region, nation = F.col("n_regionkey"), F.col("n_nationkey")
    own = F.array(F.struct(F.lit("nation").alias("property"), F.lit("=").alias("comparator"),
                           F.parse_json(nation.cast("string")).alias("value")))
    start = F.when(region > 1, F.lit(NOW).cast("long") - DAY * (nation - 10))
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        (region == 0).alias("boolean"),
        start.alias("rollout_start"),
        F.when(region > 2, start + DAY * nation).alias("rollout_end"),
        own.alias("user")).select(*FLAG_SPECS.fieldNames())


def flag_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean before user condition before rollout, each of them per customer."""
    nation = F.col("c_nationkey")
    start = now() - DAY * (nation - 10)
    spec = F.struct(
        F.lit("flag").alias("name"), (nation < 3).alias("boolean"),
        F.when(nation < 20, start).alias("rollout_start"),
        F.when(nation < 18, start + 5 * DAY).alias("rollout_end"),
        F.array(_condition("segment", "=", '"BUILDING"')).alias("user"))
    return customers(spark, sf_dir).select(
        "c_custkey", flags.flag_value(
            flags.keyed_spec(spec), _keys(), now(), rand()).alias("enabled"))


def flags_for_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.flags_for_users(customers(spark, sf_dir), nation_specs(spark, sf_dir),
                                 now(), rand(), "c_custkey")


def flag_spec_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    term = F.array(F.lit("brand"), F.when(size % 6 == 0, F.lit("like")).otherwise(F.lit("=")),
                   F.col("p_brand"))
    user = F.when(size % 5 == 0, F.array(term, F.array(F.lit("brand"), F.lit("=")))).otherwise(
        F.array(term))
    specs = table(spark, sf_dir, "part").select(
        "p_partkey", user.alias("user"),
        F.when(size % 4 != 0, size.cast("long")).alias("rollout_start"),
        F.when(size % 3 != 0, F.lit(20).cast("long")).alias("rollout_end"))
    return flag_specs.spec_rejects(specs).select("p_partkey", "reason")


def flag_spec_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order resubmits the flag of its customer."""
    updates = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("flag "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("boolean"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("rollout_start"))
    return flag_specs.upsert_specs(updates)


def flag_bool_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    words = F.array(*[F.lit(w) for w in ("enabled", "true", "disabled", "false", "undefined",
                                         "TRUE", "7")])
    text = F.try_element_at(words, (size % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", flag_specs.boolean_from_text(text).alias("boolean"),
        flag_specs.bound_from_text(text).alias("bound"))


def flag_spec_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = parsed_specs(spark, sf_dir).filter(F.col("reason").isNull())
    return flag_specs.render_specs(specs)


def flag_spec_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    shouted = F.when(F.col("p_type") == "ECONOMY", F.upper("p_name")).otherwise(
        F.col("p_name"))
    specs = table(spark, sf_dir, "part").select(
        F.concat_ws(" ", shouted, F.col("p_partkey").cast("string")).alias("name"))
    return flag_specs.list_specs(specs)


def rollout_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit(NOW).cast("long") + F.col("p_size") * DAY
    specs = table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        start.alias("rollout_start"), (start + 10 * DAY).alias("rollout_end"))
    return flags.rollout_exposure(specs, DAY).select("name", "at", rounded("chance"))


QUERIES = {
    "flag_boolean": flag_boolean,
    "flag_user_eq": flag_user_eq,
    "flag_user_in": flag_user_in,
    "flag_user_or": flag_user_or,
    "flag_rollout": flag_rollout,
    "flag_precedence": flag_precedence,
    "flags_for_users": flags_for_users,
    "flag_spec_rejects": flag_spec_rejects,
    "flag_spec_upsert": flag_spec_upsert,
    "flag_bool_coerce": flag_bool_coerce,
    "flag_spec_render": flag_spec_render,
    "flag_spec_list": flag_spec_list,
    "rollout_exposure": rollout_exposure,
}
