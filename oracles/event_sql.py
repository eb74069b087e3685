"""SQL for reading events, counting them, goals."""

from __future__ import annotations

from oracles.parts import (FACTS, FIXED_GOALS, KEY, KEYED, MARKED, PRIOR, STEP_LOG, STREAM_GOALS,
                           TAG_COUNTS, TOTALS, TYPED_LOG, counted, statement)

SENT = """CASE WHEN k < 50 THEN 'default' ELSE 'beta' END AS namespace,
  event_type AS event_name, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN k BETWEEN 40 AND 59 THEN NULL ELSE value END AS value,
  event_type = 'purchase' AS ensure_goal,
  CAST(isoyear(ts) AS INT) AS iso_year, CAST(week(ts) AS INT) AS iso_week"""


def _ingested(request: str, pos: str, shape: str) -> str:
    return statement(KEYED, select=f"""
SELECT {request} AS request_seq, CAST({pos} AS INT) AS pos, {shape} AS shape, {SENT}
FROM k_events""")


FLAG_REQUESTS = """requests AS (
  SELECT c_custkey AS seq, c_nationkey AS n, c_mktsegment AS segment, c_acctbal AS balance
  FROM customer)"""

SPECS = """specs AS (
  SELECT p_partkey, p_size AS s, p_brand,
    CASE WHEN p_size = 1 THEN 'missing_required_key'
         WHEN p_size = 2 THEN 'invalid_date'
         WHEN p_size = 4 THEN 'invalid_condition' END AS reason,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
    p_type = 'ECONOMY' AS boolean,
    CAST(1704067200 + 86400 * p_size AS BIGINT) AS rollout_start,
    CASE WHEN p_size <> 3 THEN CAST(1704067200 + 86400 * (p_size + 10) AS BIGINT) END
      AS rollout_end,
    'brand = "' || p_brand || '"|size in [' || CAST(p_size AS VARCHAR) || ','
      || CAST(p_size + 1 AS VARCHAR) || ']' AS conditions
  FROM part)"""

DAMAGED = """damaged AS (
  SELECT p_partkey, p_size,
    CASE WHEN p_size % 5 = 0 THEN 'fixed' WHEN p_size % 5 = 1 THEN 'bloom_fixed_size'
         ELSE 'bloom_scalable' END AS kind,
    CASE WHEN p_size > 3 THEN p_size END AS size,
    CASE WHEN p_type <> 'ECONOMY' THEN 0.01 END AS error_probability,
    CASE WHEN p_size % 7 = 0 THEN 'weekly' WHEN p_size % 7 = 1 THEN 'monthly' END
      AS date_cohort
  FROM part)"""

MARKED_BY_STREAM = [TYPED_LOG, FACTS, STREAM_GOALS, MARKED]
UNMARKED = [TYPED_LOG, FACTS, FIXED_GOALS, MARKED, TOTALS]

EVENTS: dict[str, str] = {
    "ingest_json_single": _ingested("event_id", "0", "'single'"),
    "ingest_json_envelope": _ingested("event_id // 10", "event_id % 10", "'envelope'"),
    "ingest_json_array": _ingested("event_id // 10", "event_id % 10", "'array'"),
    "ingest_one_of": _ingested(
        "event_id", "0",
        "CASE WHEN k < 33 THEN 'single' WHEN k < 66 THEN 'envelope' ELSE 'array' END"),
    "ingest_rejects": statement(KEYED, select="""
SELECT event_id AS request_seq,
  CASE WHEN k < 10 THEN 'missing_required_key' WHEN k < 20 THEN 'incorrect_type'
       WHEN k < 30 THEN 'invalid_date' WHEN k < 40 THEN 'matches_more_than_one_shape'
       WHEN k < 50 THEN 'missing_required_key' WHEN k < 60 THEN 'invalid_json'
       ELSE 'incorrect_type' END AS reason
FROM k_events WHERE k < 70"""),
    "ingest_defaults": """
SELECT event_id AS request_seq, 'default' AS namespace, event_type AS event_name,
  CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS DOUBLE) AS value,
  FALSE AS ensure_goal, CAST(isoyear(ts) AS INT) AS iso_year,
  CAST(week(ts) AS INT) AS iso_week
FROM events""",
    "normalize_user_id": """
SELECT CAST(user_id AS VARCHAR) AS user_id, 2 * count(*) AS events FROM events GROUP BY 1""",
    "iso_week_bucket": """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders,
  CAST(any_value(strftime(o_orderdate, '%G')) AS INT) AS iso_year,
  CAST(any_value(strftime(o_orderdate, '%V')) AS INT) AS iso_week
FROM orders GROUP BY 1""",
    "ingest_csv": """
SELECT o_orderkey AS seq, 'default' AS namespace,
  'order: ' || o_orderpriority || ',' || o_orderstatus AS event_name,
  CAST(o_custkey AS VARCHAR) AS user_id, TRUE AS ensure_goal
FROM orders""",
    "ingest_csv_files": """
SELECT 'default' AS namespace, 'order: ' || o_orderpriority AS event_name,
  CAST(o_custkey AS VARCHAR) AS user_id, FALSE AS ensure_goal,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS position
FROM orders""",
    "wide_to_events": """
WITH wide AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS seq, 'default' AS namespace, 'priority:' || o_orderpriority AS event_name,
  CAST(o_orderkey AS VARCHAR) AS user_id, FALSE AS ensure_goal FROM wide
UNION ALL
SELECT CAST(pow(2, 56) AS BIGINT) + o_orderkey, 'default', 'segment:' || c_mktsegment,
  CAST(o_orderkey AS VARCHAR), FALSE FROM wide
UNION ALL
SELECT 2 * CAST(pow(2, 56) AS BIGINT) + o_orderkey, 'default', 'status:' || o_orderstatus,
  CAST(o_orderkey AS VARCHAR), TRUE FROM wide""",
    "usage_events_from_requests": statement(FLAG_REQUESTS, select="""
SELECT seq, 'default' AS namespace, segment AS event_name, CAST(seq AS VARCHAR) AS user_id
FROM requests WHERE n > 3 AND balance >= 0"""),
    "parse_feature_specs": statement(SPECS, select="""
SELECT p_partkey, reason,
  CASE WHEN reason IS NULL THEN name END AS name,
  CASE WHEN reason IS NULL THEN boolean END AS boolean,
  CASE WHEN reason IS NULL THEN rollout_start END AS rollout_start,
  CASE WHEN reason IS NULL THEN rollout_end END AS rollout_end,
  CASE WHEN reason IS NULL THEN conditions END AS conditions
FROM specs"""),
    "request_rejects": statement(FLAG_REQUESTS, select="""
SELECT seq, CASE WHEN n = 1 THEN 'invalid_json' ELSE 'invalid_base64' END AS reason
FROM requests WHERE n IN (0, 1, 3)"""),
    "counter_fanout": statement(TYPED_LOG, select=f"""
SELECT namespace, 'global_counter' AS event_name, 'internal' AS counter_type,
  CAST(NULL AS INT) AS iso_year, CAST(NULL AS INT) AS iso_week, count(*) AS writes
FROM log GROUP BY namespace
UNION ALL
SELECT namespace, event_name, 'named', NULL, NULL, count(*) FROM log
GROUP BY namespace, event_name
UNION ALL
SELECT namespace, event_name, 'weekly', iso_year, iso_week, count(*) FROM log
WHERE event_name IN ('purchase', 'signup') GROUP BY namespace, event_name, iso_year, iso_week"""),
    "first_writes": statement(TYPED_LOG, FACTS, select="SELECT * FROM facts"),
    "first_writes_merge": statement(TYPED_LOG, FACTS, select="SELECT * FROM facts"),
    "unique_users_by_event": statement(TYPED_LOG, select="""
SELECT namespace, event_name, count(DISTINCT user_id) AS count FROM log GROUP BY ALL"""),
    "unique_users_global": statement(TYPED_LOG, select="""
SELECT namespace, count(DISTINCT user_id) AS count FROM log GROUP BY ALL"""),
    "unique_users_weekly": statement(TYPED_LOG, select="""
SELECT namespace, event_name, iso_year, iso_week, count(DISTINCT user_id) AS count
FROM log WHERE event_name IN ('purchase', 'signup') GROUP BY ALL"""),
    "value_sum_first_write": statement(TYPED_LOG, FACTS, select=f"""
SELECT {KEY}, round(sum(value), 6) AS value_sum FROM facts GROUP BY ALL"""),
    "value_avg": statement(TYPED_LOG, FACTS, select="""
SELECT namespace, event_name, round(sum(value) / count(*), 6) AS value_avg
FROM named GROUP BY ALL"""),
    "goal_prior_events": statement(TYPED_LOG, FACTS, FIXED_GOALS, MARKED, PRIOR,
                                   select="SELECT * FROM prior"),
    "tag_combination_counts": statement(counted(TYPED_LOG), TAG_COUNTS, select=f"""
SELECT {KEY}, tags, count FROM tag_counts t
WHERE EXISTS (SELECT 1 FROM marked m WHERE m.is_goal AND m.namespace = t.namespace
  AND m.event_name = t.event_name AND m.counter_type = t.counter_type
  AND m.iso_year IS NOT DISTINCT FROM t.iso_year
  AND m.iso_week IS NOT DISTINCT FROM t.iso_week)"""),
    "tag_counts_non_goal": statement(TYPED_LOG, FACTS, FIXED_GOALS, MARKED, select=f"""
SELECT {KEY}, '' AS tags, count(*) AS count FROM marked WHERE NOT is_goal GROUP BY ALL"""),
    "single_tag_counts": statement(counted(TYPED_LOG), select="SELECT * FROM singles"),
    "weekly_goal_tags": statement(counted(TYPED_LOG), select="""
SELECT namespace, event_name, iso_year, iso_week, tag, count FROM singles
WHERE counter_type = 'weekly'"""),
    "counter_config_match": statement(STEP_LOG, select="""
SELECT event_name, CAST(rule AS INT) AS rule,
  CASE WHEN rule = 2 THEN 'bloom_fixed_size' ELSE 'bloom_scalable' END AS kind,
  CAST(CASE rule WHEN 2 THEN 10000 WHEN 3 THEN 5000 ELSE 100000 END AS BIGINT) AS size,
  CAST(CASE WHEN rule = 3 THEN 0.01 ELSE 0.001 END AS DOUBLE) AS error_probability,
  CASE WHEN rule = 1 THEN 'weekly' END AS date_cohort
FROM (SELECT DISTINCT event_name,
        CASE WHEN event_name IN ('purchase', 'signup') THEN 1
             WHEN event_name IN ('view 0', 'view 1', 'view 2', 'view 3', 'view 4') THEN 2
             WHEN starts_with(event_name, 'view') THEN 3 ELSE 0 END AS rule
      FROM log)"""),
    "counter_config_rejects": statement(DAMAGED, select="""
SELECT p_partkey, reason FROM (
  SELECT p_partkey,
    CASE WHEN date_cohort = 'monthly' THEN 'unknown_date_cohort'
         WHEN size IS NULL OR (kind = 'bloom_scalable' AND error_probability IS NULL)
           THEN 'missing_setting'
         WHEN kind = 'fixed' THEN 'unknown_kind' END AS reason
  FROM damaged) WHERE reason IS NOT NULL"""),
    "approx_unique_users": statement(TYPED_LOG, select="""
SELECT namespace, event_name, count(DISTINCT user_id) AS exact,
  CAST(greatest(1, ceil(0.03 * count(DISTINCT user_id))) AS BIGINT) AS bound,
  CAST(0 AS BIGINT) AS hll_plus_over, CAST(0 AS BIGINT) AS hll_over,
  CAST(0 AS BIGINT) AS theta_over
FROM log GROUP BY namespace, event_name"""),
    "bloom_membership": statement(STEP_LOG, select="""
SELECT namespace, event_name, probes, done, CAST(0 AS BIGINT) AS missed,
  CAST(greatest(1, ceil(probes * 1.1 / CASE WHEN p = 0.01 THEN 100 ELSE 120 END)) AS BIGINT)
    AS slices,
  CASE WHEN p = 0.01 THEN 7 ELSE 10 END AS hashes,
  CAST(floor((probes - done) * p + 4 * sqrt((probes - done) * p) + 2) AS BIGINT) AS allowed,
  CAST(0 AS BIGINT) AS over
FROM (
  SELECT p.namespace, p.event_name, count(*) AS probes, count(d.user_id) AS done,
    CASE WHEN starts_with(p.event_name, 'view') THEN 0.01::DOUBLE ELSE 0.001::DOUBLE END AS p
  FROM (SELECT DISTINCT namespace, event_name, CAST(CAST(user_id AS BIGINT) + 1 AS VARCHAR)
          AS user_id FROM log) p
  LEFT JOIN (SELECT DISTINCT namespace, event_name, user_id FROM log) d
    ON d.namespace = p.namespace AND d.event_name = p.event_name AND d.user_id = p.user_id
  GROUP BY p.namespace, p.event_name)"""),
    "bloom_growth": """
WITH asked AS (
  SELECT DISTINCT o_orderpriority AS event_name, o_custkey + 1 AS customer FROM orders),
known AS (SELECT DISTINCT o_orderpriority AS event_name, o_custkey AS customer FROM orders),
counts AS (
  SELECT event_name, count(*) AS probes, count(known.customer) AS done
  FROM asked LEFT JOIN known USING (event_name, customer) GROUP BY event_name)
SELECT 'orders' AS namespace, event_name, probes, done, CAST(0 AS BIGINT) AS missed,
  CAST(floor((probes - done) * 0.015::DOUBLE + 4 * sqrt((probes - done) * 0.015::DOUBLE) + 2)
    AS BIGINT) AS allowed,
  CAST(0 AS BIGINT) AS over
FROM counts""",
    "sketch_merge": statement(TYPED_LOG, select="""
SELECT namespace, event_name, count(DISTINCT user_id) AS exact,
  CAST(greatest(1, ceil(0.03 * count(DISTINCT user_id))) AS BIGINT) AS bound,
  CAST(0 AS BIGINT) AS over
FROM log GROUP BY namespace, event_name"""),
    "user_has_event": statement(TYPED_LOG, select="""
SELECT 'default' AS namespace, 'purchase' AS event_name, CAST(c_custkey AS VARCHAR) AS user_id
FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (
  SELECT user_id FROM log WHERE namespace = 'default' AND event_name = 'purchase')"""),
    "events_for_user": statement(STEP_LOG, select="""
SELECT DISTINCT namespace, user_id, event_name FROM log"""),
    "namespace_counts": statement(counted(TYPED_LOG), TAG_COUNTS, select="""
SELECT t.* EXCLUDE (value_sum), round(t.value_sum, 6) AS value_sum,
  (SELECT count(*) FROM tag_counts c WHERE c.namespace = t.namespace
     AND c.event_name = t.event_name AND c.counter_type = t.counter_type
     AND c.iso_year IS NOT DISTINCT FROM t.iso_year
     AND c.iso_week IS NOT DISTINCT FROM t.iso_week) AS combinations,
  t.count AS combination_users,
  (SELECT count(*) FROM singles c WHERE c.namespace = t.namespace
     AND c.event_name = t.event_name AND c.counter_type = t.counter_type
     AND c.iso_year IS NOT DISTINCT FROM t.iso_year
     AND c.iso_week IS NOT DISTINCT FROM t.iso_week) AS single_events,
  (SELECT CAST(coalesce(sum(c.count), 0) AS BIGINT) FROM singles c
     WHERE c.namespace = t.namespace
     AND c.event_name = t.event_name AND c.counter_type = t.counter_type
     AND c.iso_year IS NOT DISTINCT FROM t.iso_year
     AND c.iso_week IS NOT DISTINCT FROM t.iso_week) AS single_users
FROM totals t"""),
    "count_map": statement(STEP_LOG, select="""
SELECT s.namespace, s.event_name, t.count
FROM (SELECT DISTINCT namespace, event_name FROM log) s
LEFT JOIN (SELECT CASE WHEN k < 50 THEN 'default' ELSE 'beta' END AS namespace,
             event_type AS event_name, count(DISTINCT user_id) AS count
           FROM k_events GROUP BY ALL) t USING (namespace, event_name)"""),
    "namespaces": statement(TYPED_LOG, select="SELECT DISTINCT namespace FROM log"),
    "goals_upsert": """
SELECT o_orderpriority AS namespace, 'status:' || o_orderstatus AS goal_name,
  min(o_orderkey) AS active_from_seq FROM orders GROUP BY 1, 2""",
    "ensure_goal_activation": statement(TYPED_LOG, STREAM_GOALS, select="SELECT * FROM goals"),
    "goal_temporal_status": statement(*MARKED_BY_STREAM, select=f"""
SELECT {KEY}, is_goal, count(*) AS users FROM marked WHERE counter_type <> 'internal'
GROUP BY ALL"""),
    "goals_list": """
SELECT *, CAST(row_number() OVER (PARTITION BY namespace ORDER BY goal_name) AS INT) AS rank
FROM (SELECT DISTINCT o_orderpriority AS namespace, 'status:' || o_orderstatus AS goal_name
      FROM orders)""",
    "drop_counter": statement(*UNMARKED, select=f"""
SELECT {KEY}, count FROM totals WHERE NOT (event_name = 'error' AND counter_type = 'named')"""),
    "counter_display": statement(*UNMARKED, select="""
SELECT namespace, CASE WHEN counter_type = 'weekly'
    THEN event_name || ' ' || CAST(iso_year AS VARCHAR) || CAST(iso_week AS VARCHAR)
    ELSE event_name END AS name, counter_type, count
FROM totals"""),
    "registered_counters": statement(*UNMARKED, select="""
SELECT count(*) AS counters FROM totals"""),
}
