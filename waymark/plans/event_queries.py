"""Registered queries: reading events, counting them, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waymark.functions.dates import iso_week, iso_year
from waymark.functions.names import normalize_user_id, tags_text
from waymark.operators import cohorts, counters, facts as fact_ops, goals as goal_ops
from waymark.operators import membership, sketches
from waymark.plans.inputs import (WEEKLY_RULES, event_k, goal_table, step_log, table,
                                  typed_log)
from waymark.schemas import COUNTER_KEY, INTERNAL, NAMED, WEEKLY
from waymark.sources import (accepted_events, events_from_lines, parse_flag_requests,
                             parse_flag_specs, parse_requests, read_event_files,
                             rejected_requests, usage_events, wide_to_events)
from waymark.sources.wide import Pass
from waymark.storage import materialize, new_path

DIGITS = 6


def rounded(column: str) -> Column:
    """Six digits, by way of ten: a product of factors may end a hair below a tie."""
    return F.round(F.round(F.col(column), 10), DIGITS).alias(column)


# --- reading and checking -------------------------------------------------------------

def _event_body(k: Column) -> Column:
    """An event as clients send it: absent fields are left out."""
    return F.struct(
        F.col("event_type").alias("event_name"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(k >= 50, F.lit("beta")).alias("namespace"),
        F.when(~k.between(40, 59), F.col("value")).alias("value"),
        F.when(F.col("event_type") == "purchase", F.lit(True)).alias("ensure_goal"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"))


_LOG_COLUMNS = ["request_seq", "pos", "shape", "namespace", "event_name", "user_id", "value",
                "ensure_goal", "iso_year", "iso_week"]


def _requests(events: DataFrame, body: Column) -> DataFrame:
    return events.select(F.col("event_id").alias("request_seq"), body.alias("body"))


def _batched(events: DataFrame) -> DataFrame:
    """Ten consecutive events per request."""
    return (events.withColumn("event", _event_body(event_k()))
            .groupBy(F.floor(F.col("event_id") / 10).cast("long").alias("request_seq"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event"))),
                             lambda e: e["event"]).alias("events")))


def ingest_json_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parsed = parse_requests(_requests(events, F.to_json(_event_body(event_k()))))
    return accepted_events(parsed).select(*_LOG_COLUMNS)


def ingest_json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _batched(table(spark, sf_dir, "events")).select(
        "request_seq", F.to_json(F.struct("events")).alias("body"))
    return accepted_events(parse_requests(requests)).select(*_LOG_COLUMNS)


def ingest_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _batched(table(spark, sf_dir, "events")).select(
        "request_seq", F.to_json("events").alias("body"))
    return accepted_events(parse_requests(requests)).select(*_LOG_COLUMNS)


def ingest_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all three shapes mixed, told apart by their form."""
    k = event_k()
    body = (F.when(k < 33, F.to_json(_event_body(k)))
            .when(k < 66, F.to_json(F.struct(F.array(_event_body(k)).alias("events"))))
            .otherwise(F.to_json(F.array(_event_body(k)))))
    parsed = parse_requests(_requests(table(spark, sf_dir, "events"), body))
    return accepted_events(parsed).select(*_LOG_COLUMNS)


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests damaged in different ways, each with the reason for its rejection."""
    k = event_k()
    user, name = F.col("user_id").cast("string"), F.col("event_type")
    good = F.struct(name.alias("event_name"), user.alias("user_id"))
    body = (F.when(k < 10, F.to_json(F.struct(user.alias("user_id"))))
            .when(k < 20, F.to_json(F.struct(name.alias("event_name"), user.alias("user_id"),
                                             F.lit("foo").alias("value"))))
            .when(k < 30, F.to_json(F.struct(name.alias("event_name"), user.alias("user_id"),
                                             F.lit("2020").alias("datetime"))))
            .when(k < 40, F.to_json(F.struct(name.alias("event_name"), user.alias("user_id"),
                                             F.array(good).alias("events"))))
            .when(k < 50, F.concat(F.lit('{"events":['), F.to_json(good), F.lit(","),
                                   F.to_json(F.struct(user.alias("user_id"))), F.lit("]}")))
            .when(k < 60, F.concat(F.lit("{"), name))
            .when(k < 70, F.to_json(F.struct(name.alias("event_name"),
                                             F.col("user_id").alias("user_id"))))
            .otherwise(F.to_json(good)))
    parsed = parse_requests(_requests(table(spark, sf_dir, "events"), body))
    return rejected_requests(parsed).select("request_seq", "reason")


def ingest_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the required fields are sent; the rest is filled in."""
    body = F.to_json(F.struct(F.col("event_type").alias("event_name"),
                              F.col("user_id").cast("string").alias("user_id")))
    events = table(spark, sf_dir, "events")
    requests = events.select(F.col("event_id").alias("request_seq"), body.alias("body"),
                             F.col("ts").alias("received_at"))
    log = accepted_events(parse_requests(requests), received_at="received_at")
    return log.select("request_seq", "namespace", "event_name", "user_id", "value",
                      "ensure_goal", "iso_year", "iso_week")


def normalized_user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids arrive as numbers and as texts; both name one user."""
    events = table(spark, sf_dir, "events")
    numbers = events.select(normalize_user_id(F.col("user_id")).alias("user_id"))
    texts = events.select(
        normalize_user_id(F.col("user_id").cast("string")).alias("user_id"))
    return numbers.unionAll(texts).groupBy("user_id").agg(F.count("*").alias("events"))


def iso_week_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return (orders.groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(F.count("*").alias("orders"))
            .select(F.date_format("day", "yyyy-MM-dd").alias("day"), "orders",
                    iso_year(F.col("day")).alias("iso_year"),
                    iso_week(F.col("day")).alias("iso_week")))


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ``user,event`` lines, some with blanks and further commas."""
    line = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" , "),
                    F.col("o_orderpriority"), F.lit(","), F.col("o_orderstatus"), F.lit(" "))
    lines = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), line.alias("value"))
    return events_from_lines(lines, event_prefix="order: ", goal=True).select(
        "seq", "namespace", "event_name", "user_id", "ensure_goal")


def ingest_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines written as text files by order key and read back in their order."""
    path = new_path(spark, "lines")
    line = F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    (table(spark, sf_dir, "orders").repartitionByRange(4, "o_orderkey")
     .sortWithinPartitions("o_orderkey").select(line.alias("value")).write.text(path))
    arrival = Window.partitionBy("user_id").orderBy("seq")
    return read_event_files(spark, path, event_prefix="order: ").select(
        "namespace", "event_name", "user_id", "ensure_goal",
        F.row_number().over(arrival).alias("position"))


ORDER_PASSES = (Pass("o_orderpriority", "priority:"), Pass("c_mktsegment", "segment:"),
                Pass("o_orderstatus", "status:", goal=True))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as users: priority and segment events, then the status as goal."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    wide = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return wide_to_events(wide, "o_orderkey", "o_orderkey", ORDER_PASSES)


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events(spark, sf_dir).select("seq", "namespace", "event_name", "user_id",
                                              "ensure_goal")


def _flag_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers asking for flags: some without a feature, some with damaged texts."""
    user = F.to_json(F.struct(F.col("c_custkey").alias("user_id"),
                              F.col("c_mktsegment").alias("segment")))
    context = F.when(F.col("c_acctbal") < 0, F.to_json(F.struct(
        F.lit("none").alias("other")))).otherwise(
        F.to_json(F.struct(F.col("c_mktsegment").alias("feature"))))
    nation = F.col("c_nationkey")
    user_obj = (F.when(nation == 0, F.lit("not base64!"))
                .when(nation == 1, F.base64(F.encode(F.lit("{user"), "UTF-8")))
                .when(nation != 2, F.base64(F.encode(user, "UTF-8"))))
    context_obj = F.when(nation == 3, F.lit("@@@@")).otherwise(
        F.base64(F.encode(context, "UTF-8")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), user_obj.alias("user_obj"),
        context_obj.alias("context_obj"))


def usage_events_from_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(parse_flag_requests(_flag_requests(spark, sf_dir))).select(
        "seq", "namespace", "event_name", "user_id")


def request_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (parse_flag_requests(_flag_requests(spark, sf_dir))
            .filter(F.col("reason").isNotNull()).select("seq", "reason"))


def spec_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag spec per part, with rollout dates, conditions and some defects."""
    size = F.col("p_size")
    day = lambda days: F.date_format(
        F.date_add(F.lit("2024-01-01").cast("date"), days), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    is_in = F.struct(F.lit("size").alias("property"), F.lit("in").alias("comparator"),
                     F.array(size, size + 1).alias("value"))
    equals = F.struct(F.lit("brand").alias("property"),
                      F.when(size == 4, F.lit("like")).otherwise(F.lit("=")).alias("comparator"),
                      F.col("p_brand").alias("value"))
    head = F.to_json(F.struct(
        F.when(size != 1, F.concat_ws(" ", "p_name", "p_partkey")).alias("name"),
        (F.col("p_type") == "ECONOMY").alias("boolean"),
        F.when(size != 2, day(size)).otherwise(F.lit("2020")).alias("rollout_start"),
        F.when(size != 3, day(size + 10)).alias("rollout_end")))
    conditions = F.concat(F.lit(',"user":['), F.to_json(equals), F.lit(","),
                          F.to_json(is_in), F.lit("]}"))
    body = F.concat(F.substring(head, 1, F.length(head) - 1), conditions)
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


def parsed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_flag_specs(spec_bodies(spark, sf_dir))


def parse_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_specs(spark, sf_dir).select(
        "p_partkey", "reason",
        *[F.when(F.col("reason").isNull(), F.col(c)).alias(c)
          for c in ("name", "boolean", "rollout_start", "rollout_end")],
        F.when(F.col("reason").isNull(), F.array_join(F.transform(
            "user", lambda c: F.concat_ws(" ", c["property"], c["comparator"],
                                          F.to_json(c["value"]))), "|")).alias("conditions"))


# --- counting -------------------------------------------------------------------------

def weekly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_ops.first_writes(typed_log(spark, sf_dir), WEEKLY_RULES)


def marked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts with goal marks, written once because several results read them."""
    marked = goal_ops.mark_goals(weekly_facts(spark, sf_dir), goal_table(spark))
    return materialize(marked, "facts")


def facts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the days up to January 15th, extended by those of the later days."""
    log = typed_log(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    stored = materialize(fact_ops.first_writes(log.filter(early), WEEKLY_RULES), "facts")
    added = fact_ops.first_writes(log.filter(~early), WEEKLY_RULES)
    return fact_ops.merge_first_writes(stored, added)


def counter_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fact_ops.fan_out(typed_log(spark, sf_dir), WEEKLY_RULES)
            .groupBy(*COUNTER_KEY).agg(F.count("*").alias("writes")))


def first_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_facts(spark, sf_dir)


def unique_users_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fact_ops.named_first_writes(typed_log(spark, sf_dir))
    return counters.counter_totals(named).select("namespace", "event_name", "count")


def unique_users_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_log(spark, sf_dir).groupBy("namespace").agg(
        F.count_distinct("user_id").alias("count"))


def unique_users_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = counters.counter_totals(weekly_facts(spark, sf_dir))
    return counters.weekly_totals(totals).select("namespace", "event_name", "iso_year",
                                                 "iso_week", "count")


def value_sum_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.counter_totals(weekly_facts(spark, sf_dir)).select(
        *COUNTER_KEY, rounded("value_sum"))


def value_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fact_ops.named_first_writes(typed_log(spark, sf_dir))
    return counters.average_values(counters.counter_totals(named)).select(
        "namespace", "event_name", rounded("value_avg"))


def goal_prior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_ops.prior_events(marked_facts(spark, sf_dir)).select(
        *COUNTER_KEY, "user_id", "goal_seq", "tag")


def written_prior(marked: DataFrame) -> DataFrame:
    """Prior events, written because combinations read them twice."""
    return materialize(fact_ops.prior_events(marked), "prior")


def _tag_counts(marked: DataFrame) -> DataFrame:
    return counters.tag_counts(counters.counter_totals(marked), written_prior(marked))


def tag_combination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = marked_facts(spark, sf_dir)
    goals = marked.filter("is_goal").select(*COUNTER_KEY).distinct()
    return (_tag_counts(marked).alias("t")
            .join(goals.alias("g"), counters.same_counter("t", "g"), "left_semi")
            .select(*COUNTER_KEY, tags_text("tags").alias("tags"), "count"))


def tag_counts_non_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = marked_facts(spark, sf_dir)
    non_goals = marked.filter(~F.col("is_goal"))
    return (_tag_counts(non_goals)
            .select(*COUNTER_KEY, tags_text("tags").alias("tags"), "count"))


def single_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = fact_ops.prior_events(marked_facts(spark, sf_dir))
    return counters.single_tag_counts(prior)


def weekly_goal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = fact_ops.prior_events(marked_facts(spark, sf_dir)).filter(
        F.col("counter_type") == WEEKLY)
    return counters.single_tag_counts(prior).select(
        "namespace", "event_name", "iso_year", "iso_week", "tag", "count")


def counter_config_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = step_log(spark, sf_dir).select("event_name").distinct()
    rules = (cohorts.CohortRule("purchase|signup", date_cohort=WEEKLY),
             cohorts.CohortRule("view [0-4]", kind=cohorts.FIXED_SIZE, size=10_000),
             cohorts.CohortRule("^view", size=5_000, error_probability=0.01))
    return cohorts.with_counter_settings(names, rules)


def counter_config_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    settings = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("pattern"),
        F.when(size % 5 == 0, F.lit("fixed")).when(size % 5 == 1, F.lit(cohorts.FIXED_SIZE))
        .otherwise(F.lit(cohorts.SCALABLE)).alias("kind"),
        F.when(size > 3, size.cast("long")).alias("size"),
        F.when(F.col("p_type") != "ECONOMY", F.lit(0.01)).alias("error_probability"),
        F.when(size % 7 == 0, F.lit("weekly")).when(size % 7 == 1, F.lit("monthly"))
        .alias("date_cohort"))
    return cohorts.setting_rejects(settings).select("p_partkey", "reason")


def _beyond(estimate: str) -> Column:
    """By how many users an estimate misses more than ``bound`` allows."""
    off = F.ceil(F.abs(F.col(estimate) - F.col("exact"))).cast("long")
    return F.greatest(off - F.col("bound"), F.lit(0)).cast("long")


def _bound(error: float) -> Column:
    """Three standard errors of the exact count, at least one user."""
    return F.greatest(F.lit(1), F.ceil(3 * error * F.col("exact"))).cast("long").alias("bound")


def approx_unique_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch estimates next to the exact count: how far each is beyond three errors."""
    error = 0.01
    log = typed_log(spark, sf_dir)
    exact = counters.counter_totals(fact_ops.named_first_writes(log)).select(
        "namespace", "event_name", F.col("count").alias("exact"))
    estimates = sketches.approximate_unique_users(log, "namespace", "event_name", error=error)
    return estimates.join(exact, ["namespace", "event_name"]).select(
        "*", _bound(error)).select(
        "namespace", "event_name", "exact", "bound",
        _beyond("hll_plus_estimate").alias("hll_plus_over"),
        _beyond("hll_estimate").alias("hll_over"), _beyond("theta_estimate").alias("theta_over"))


def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did the next user do the same event? Asked of the filters and answered exactly.

    The rules give too small sizes, so that the filters have to grow. ``allowed`` is how often
    they may err, from each counter's own probability; ``over`` counts errors beyond it.
    """
    named = materialize(fact_ops.named_first_writes(step_log(spark, sf_dir)), "facts")
    rules = (cohorts.CohortRule("^view", size=100, error_probability=0.01),
             cohorts.CohortRule(".*", size=120, error_probability=0.001))
    counted = counters.counter_totals(named).select("namespace", "event_name", "count")
    plans = materialize(membership.filter_plans(
        cohorts.with_counter_settings(counted, rules)), "filter-plans")
    next_user = (F.col("user_id").cast("long") + 1).cast("string")
    probes = named.withColumn("user_id", next_user).select(*membership.PROBE)
    answers = membership.probably_done(
        probes, membership.build_filters(named, plans), plans)
    exact = membership.users_with_event(probes, named).withColumn("done", F.lit(True))
    done = F.coalesce("done", F.lit(False))
    return (answers.join(exact, membership.PROBE, "left")
            .groupBy("namespace", "event_name")
            .agg(F.count("*").alias("probes"),
                 F.count_if(done).alias("done"),
                 F.count_if(done & ~F.col("member")).alias("missed"),
                 F.count_if(~done & F.col("member")).alias("false_hits"))
            .join(plans.select("namespace", "event_name", "slices", "hashes"),
                  ["namespace", "event_name"])
            .withColumn("probability", F.when(
                F.col("event_name").startswith("view"), 0.01).otherwise(0.001))
            .withColumn("allowed", allowed_errors(F.col("probes") - F.col("done"),
                                                  F.col("probability")))
            .withColumn("over", F.greatest(F.col("false_hits") - F.col("allowed"), F.lit(0)))
            .drop("false_hits", "probability"))


def allowed_errors(tries: Column, probability: Column) -> Column:
    """Errors of so many independent tries that are exceeded about once in 30,000 cases."""
    mean = tries * probability
    return F.floor(mean + 4 * F.sqrt(mean) + 2).cast("long")


def bloom_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of customers by order priority: built from the oldest third of the orders,
    stored, read again and added to, then put together with those of the last third, which
    were built elsewhere with other sizes. The next customer of each is asked for."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("namespace"), F.col("o_orderpriority").alias("event_name"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.pmod(F.col("o_orderkey"), F.lit(3)).alias("third"))
    events = materialize(orders.select("namespace", "event_name").distinct(), "counters")

    def settings(size: int, probability: float) -> DataFrame:
        return events.select("*", F.lit(cohorts.SCALABLE).alias("kind"),
                             F.lit(size).cast("long").alias("size"),
                             F.lit(probability).alias("error_probability"))

    path, small = new_path(spark, "filters"), settings(100, 0.01)
    first = membership.add_users(None, orders.where("third = 0"), small)
    membership.store_filters(first, f"{path}/first")
    grown = membership.add_users(membership.stored_filters(spark, f"{path}/first"),
                                 orders.where("third = 1"), small)
    other = membership.add_users(None, orders.where("third = 2"), settings(350, 0.005), "other")
    membership.store_filters(membership.united(grown, other), f"{path}/all")

    def distinct_users(of: DataFrame) -> DataFrame:
        """Without the namespace, which is one, in their key: the join below has it so, too."""
        found = of.select("event_name", "user_id").distinct()
        return found.select(F.lit("orders").alias("namespace"), "event_name", "user_id")

    next_user = (F.col("user_id").cast("long") + 1).cast("string")
    probes = distinct_users(orders.withColumn("user_id", next_user))
    done = distinct_users(orders).withColumn("done", F.lit(True))
    # Joined first, while both are dealt alike.
    answers = membership.in_growing(probes.join(done, membership.PROBE, "left"),
                                    membership.stored_filters(spark, f"{path}/all"))
    is_done = F.coalesce("done", F.lit(False))
    return (answers.groupBy("namespace", "event_name")
            .agg(F.count("*").alias("probes"), F.count_if(is_done).alias("done"),
                 F.count_if(is_done & ~F.col("member")).alias("missed"),
                 F.count_if(~is_done & F.col("member")).alias("false_hits"))
            .withColumn("allowed", allowed_errors(F.col("probes") - F.col("done"),
                                                  F.lit(0.015)))
            .withColumn("over", F.greatest(F.col("false_hits") - F.col("allowed"), F.lit(0)))
            .drop("false_hits"))


def sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single weeks united per event; compared with the exact count."""
    error = 0.01
    log = typed_log(spark, sf_dir)
    by_week = sketches.user_sketches(log, "namespace", "event_name", "iso_year", "iso_week",
                                     error=error)
    merged = sketches.sketch_estimates(
        sketches.merge_sketches(by_week, "namespace", "event_name"))
    exact = counters.counter_totals(fact_ops.named_first_writes(log)).select(
        "namespace", "event_name", F.col("count").alias("exact"))
    return merged.join(exact, ["namespace", "event_name"]).select("*", _bound(error)).select(
        "namespace", "event_name", "exact", "bound", _beyond("estimate").alias("over"))


# --- reading counters -----------------------------------------------------------------

def user_has_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who, as event users, made a purchase."""
    probes = table(spark, sf_dir, "customer").select(
        F.lit("default").alias("namespace"), F.lit("purchase").alias("event_name"),
        normalize_user_id(F.col("c_custkey")).alias("user_id"))
    named = fact_ops.named_first_writes(typed_log(spark, sf_dir))
    return membership.users_with_event(probes, named)


def events_for_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fact_ops.named_first_writes(step_log(spark, sf_dir))
    return counters.events_of_users(named)


def nested(marked: DataFrame, totals: DataFrame) -> DataFrame:
    prior = written_prior(marked)
    tags = materialize(counters.tag_counts(totals, prior), "tags")
    return counters.nested_counts(totals, tags, counters.single_tag_counts(prior))


def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter with its nested counts, flattened to numbers for comparison."""
    total = lambda c: F.aggregate(
        c, F.lit(0).cast("long"), lambda acc, e: acc + e["count"])
    marked = marked_facts(spark, sf_dir)
    parts = nested(marked, counters.counter_totals(marked))
    return parts.groupBy(*COUNTER_KEY).agg(
        F.max("count").alias("count"), F.max("value_sum").alias("value_sum"),
        F.sum(F.size("event_counts")).alias("combinations"),
        F.sum(total("event_counts")).alias("combination_users"),
        F.sum(F.size("single_event_counts")).alias("single_events"),
        F.sum(total("single_event_counts")).alias("single_users")).withColumn(
        "value_sum", rounded("value_sum"))


def count_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts looked up by name for every step; most steps have no counter here."""
    asked = step_log(spark, sf_dir).select("namespace", "event_name").distinct()
    totals = counters.counter_totals(fact_ops.named_first_writes(typed_log(spark, sf_dir)))
    return counters.lookup_counts(asked, totals)


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.namespaces(typed_log(spark, sf_dir))


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses registering themselves as goals again and again."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("namespace"),
        F.concat(F.lit("status:"), "o_orderstatus").alias("goal_name"),
        F.col("o_orderkey").alias("active_from_seq"))


def goals_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goal_ops.upsert_goals(_registrations(spark, sf_dir))


def ensure_goal_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goal_ops.goals_from_log(typed_log(spark, sf_dir))


def stream_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals announced in the log, written so that their size is known to the joins."""
    return materialize(goal_ops.goals_from_log(typed_log(spark, sf_dir)), "goals")


def goal_temporal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = goal_ops.mark_goals(weekly_facts(spark, sf_dir), stream_goals(spark, sf_dir))
    return (marked.filter(F.col("counter_type") != INTERNAL)
            .groupBy(*COUNTER_KEY, "is_goal").agg(F.count("*").alias("users")))


def goals_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goal_ops.list_goals(goal_ops.upsert_goals(_registrations(spark, sf_dir)))


def drop_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of error events are removed, except those of a week."""
    totals = counters.counter_totals(weekly_facts(spark, sf_dir))
    removed = (typed_log(spark, sf_dir).filter(F.col("event_name") == "error")
               .select("namespace", "event_name", F.lit(NAMED).alias("counter_type"),
                       F.lit(None).cast("int").alias("iso_year"),
                       F.lit(None).cast("int").alias("iso_week")).distinct())
    return counters.drop_counters(totals, removed).select(*COUNTER_KEY, "count")


def counter_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = counters.counter_totals(weekly_facts(spark, sf_dir))
    return counters.with_display_name(totals).select("namespace", "name", "counter_type",
                                                     "count")


def registered_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = counters.counter_totals(weekly_facts(spark, sf_dir))
    return counters.registered_counters(totals)


QUERIES = {
    "ingest_json_single": ingest_json_single,
    "ingest_json_envelope": ingest_json_envelope,
    "ingest_json_array": ingest_json_array,
    "ingest_one_of": ingest_one_of,
    "ingest_rejects": ingest_rejects,
    "ingest_defaults": ingest_defaults,
    "normalize_user_id": normalized_user_ids,
    "iso_week_bucket": iso_week_bucket,
    "ingest_csv": ingest_csv,
    "ingest_csv_files": ingest_csv_files,
    "wide_to_events": wide_events,
    "usage_events_from_requests": usage_events_from_requests,
    "parse_feature_specs": parse_specs,
    "request_rejects": request_rejects,
    "counter_fanout": counter_fanout,
    "first_writes": first_writes,
    "first_writes_merge": facts_merge,
    "unique_users_by_event": unique_users_by_event,
    "unique_users_global": unique_users_global,
    "unique_users_weekly": unique_users_weekly,
    "value_sum_first_write": value_sum_first_write,
    "value_avg": value_avg,
    "goal_prior_events": goal_prior_events,
    "tag_combination_counts": tag_combination_counts,
    "tag_counts_non_goal": tag_counts_non_goal,
    "single_tag_counts": single_tag_counts,
    "weekly_goal_tags": weekly_goal_tags,
    "counter_config_match": counter_config_match,
    "approx_unique_users": approx_unique_users,
    "bloom_membership": bloom_membership,
    "bloom_growth": bloom_growth,
    "sketch_merge": sketch_merge,
    "counter_config_rejects": counter_config_rejects,
    "user_has_event": user_has_event,
    "events_for_user": events_for_user,
    "namespace_counts": namespace_counts,
    "count_map": count_map,
    "namespaces": namespaces,
    "goals_upsert": goals_upsert,
    "ensure_goal_activation": ensure_goal_activation,
    "goal_temporal_status": goal_temporal_status,
    "goals_list": goals_list,
    "drop_counter": drop_counter,
    "counter_display": counter_display,
    "registered_counters": registered_counters,
}
