"""SQL for predictions, nudges, funnels, churn."""

from __future__ import annotations

from oracles.parts import (BAYES, FACTS_WITHOUT_WEEKS, KEYED, MARKED, PRIOR, RATIOS,
                           SINGLES, STEP_LOG, TAG_COUNTS, TOTALS, TYPED_LOG, counted,
                           rounded, statement)

TYPED = counted(TYPED_LOG, weeks=False)
TYPED_WEEKLY = counted(TYPED_LOG)
STEPS = counted(STEP_LOG, weeks=False)

ORDER_LOG = """log AS (
  SELECT o_orderkey AS seq, 'default' AS namespace, 'priority:' || o_orderpriority
    AS event_name, CAST(o_orderkey AS VARCHAR) AS user_id, CAST(NULL AS DOUBLE) AS value,
    FALSE AS ensure_goal FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT CAST(pow(2, 56) AS BIGINT) + o_orderkey, 'default', 'segment:' || c_mktsegment,
    CAST(o_orderkey AS VARCHAR), NULL, FALSE FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 2 * CAST(pow(2, 56) AS BIGINT) + o_orderkey, 'default', 'status:' || o_orderstatus,
    CAST(o_orderkey AS VARCHAR), NULL, TRUE FROM orders JOIN customer ON o_custkey = c_custkey)"""
STREAM_GOALS = """goals AS (
  SELECT namespace, event_name AS goal_name, min(seq) AS active_from_seq
  FROM log WHERE ensure_goal GROUP BY ALL)"""

# One row per asked event, repeats included.
ASKED = """asked AS (
  SELECT event_id // 4 AS request_id, CASE WHEN k < 50 THEN 'default' ELSE 'beta' END
    AS namespace, CASE WHEN k = 99 THEN 'never seen' ELSE event_type END AS event_name
  FROM k_events)"""
NAIVE_BAYES = """combined AS (
  SELECT a.request_id, a.namespace, e.goal, product(r.yes_ratio) AS yes,
    product(r.no_ratio) AS no, bool_or(a.event_name = e.goal) AS included,
    count(*) > count(r.goal) AS unknown
  FROM asked a JOIN evidence e ON e.namespace = a.namespace
  LEFT JOIN ratios r ON r.namespace = a.namespace AND r.goal = e.goal
                    AND r.event_name = a.event_name
  GROUP BY ALL),
failing AS (SELECT DISTINCT request_id, namespace, TRUE AS failed FROM combined
            WHERE unknown AND NOT included),
naive AS (
  SELECT c.*, coalesce(f.failed, FALSE) AS failed
  FROM combined c LEFT JOIN failing f USING (request_id, namespace))"""

NOTE = "'Submitted events included this goal, no prediction made'"


def _naive_columns(keys: str, usable: str) -> str:
    return f"""{keys},
  CASE WHEN {usable} THEN {rounded("yes")} END AS yes,
  CASE WHEN {usable} THEN {rounded("no")} END AS no,
  CASE WHEN {usable} THEN {rounded("yes / greatest(no, 0.1)")} END AS likelihood"""


CHURNED = """log AS (
  SELECT seq, namespace, event_name, user_id, value, FALSE AS ensure_goal FROM base
  UNION ALL
  SELECT CAST(pow(2, 62) AS BIGINT), namespace, 'last-login-4-weeks', user_id, NULL, TRUE
  FROM base GROUP BY namespace, user_id
  HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-26') >= 28)"""

SHARED_EXTERNAL = """external AS (
  SELECT namespace, event_name AS goal, round(avg(value) / 1000, 6) AS value_yes,
    round(1 - avg(value) / 1000, 6) AS value_no,
    CASE WHEN namespace = 'beta' THEN round(count(*) / (count(*) + 1000), 6) END
      AS volume_yes,
    CASE WHEN namespace = 'beta' THEN round(1000 / (count(*) + 1000), 6) END AS volume_no
  FROM log GROUP BY namespace, event_name)"""

ANALYSIS: dict[str, str] = {
    "bayes_scalar": """
SELECT c_nationkey, round((goal_tag / goal) * (goal / n) / (tag / n), 6) AS bayes
FROM (SELECT c_nationkey, count(*) AS n,
        count(*) FILTER (o_orderstatus = 'F') AS goal,
        count(*) FILTER (o_orderpriority = '1-URGENT') AS tag,
        count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS goal_tag
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)""",
    "goals_with_evidence": statement(TYPED, select="""
SELECT namespace, event_name AS goal, count AS goal_count FROM totals t
WHERE counter_type = 'named' AND EXISTS (SELECT 1 FROM singles s
  WHERE s.counter_type = 'named' AND s.namespace = t.namespace
    AND s.event_name = t.event_name)"""),
    "bayes_predictions": statement(TYPED, BAYES, select="""
SELECT namespace, goal, event_name, round(bayes, 6) AS bayes FROM bayes"""),
    "bayes_predictions_orders": statement(
        ORDER_LOG, FACTS_WITHOUT_WEEKS, STREAM_GOALS, MARKED, PRIOR, TOTALS, SINGLES, BAYES,
        select="SELECT namespace, goal, event_name, round(bayes, 6) AS bayes FROM bayes"),
    "bayes_predictions_weekly": statement(TYPED_WEEKLY, select="""
SELECT s.namespace, s.event_name AS goal, s.iso_year, s.iso_week, s.tag AS event_name,
  round((s.count / g.count) * (g.count / a.count) / (t.count / a.count), 6) AS bayes
FROM singles s
JOIN totals g USING (namespace, event_name, counter_type, iso_year, iso_week)
JOIN totals t ON t.namespace = s.namespace AND t.event_name = s.tag
  AND t.counter_type = 'named'
JOIN totals a ON a.namespace = s.namespace AND a.counter_type = 'internal'
WHERE s.counter_type = 'weekly'"""),
    "naive_bayes_events": statement(TYPED, RATIOS, ASKED, NAIVE_BAYES, select=f"""
SELECT {_naive_columns("request_id, namespace, goal", "NOT included AND NOT failed")},
  CASE WHEN failed THEN 'Event is not known in this namespace'
       WHEN included THEN {NOTE} END AS note
FROM naive"""),
    "naive_bayes_goal_note": statement(TYPED, RATIOS, ASKED, NAIVE_BAYES, select=f"""
SELECT request_id, namespace, goal, {NOTE} AS note FROM naive
WHERE included AND NOT failed"""),
    "unknown_events": statement(TYPED_LOG, ASKED, select="""
SELECT request_id, namespace, event_name FROM asked a
WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.namespace = a.namespace
  AND l.event_name = a.event_name)"""),
    "naive_bayes_users": statement(STEPS, RATIOS, select=f"""
SELECT {_naive_columns("namespace, user_id, goal", "NOT included")},
  CASE WHEN included THEN {NOTE} END AS note
FROM (SELECT d.namespace, d.user_id, r.goal, product(r.yes_ratio) AS yes,
        product(r.no_ratio) AS no, bool_or(r.goal = d.event_name) AS included
      FROM (SELECT DISTINCT namespace, user_id, event_name FROM log) d
      JOIN ratios r USING (namespace, event_name)
      GROUP BY ALL)"""),
    "prediction_request_status": statement(TYPED_LOG, select="""
SELECT c_custkey AS request_id,
  CASE WHEN c_nationkey = 1 THEN 'user_id and event cannot both be specified'
       WHEN c_nationkey > 1 AND CAST(c_custkey AS VARCHAR) NOT IN
         (SELECT user_id FROM log WHERE namespace = 'default') THEN 'No events found for user'
       ELSE 'ok' END AS status
FROM customer"""),
    "merge_external_predictions": statement(
        TYPED, RATIOS, """asked AS (
  SELECT DISTINCT 1 AS request_id, namespace, unnest(['view', 'click']) AS event_name
  FROM log)""",
        NAIVE_BAYES, SHARED_EXTERNAL, select=f"""
SELECT coalesce(i.namespace, x.namespace) AS namespace, coalesce(i.goal, x.goal) AS goal,
  {rounded("i.yes")} AS yes, {rounded("i.no")} AS no,
  {rounded("i.yes / greatest(i.no, 0.1)")} AS likelihood,
  x.value_yes, x.value_no, x.volume_yes, x.volume_no
FROM naive i FULL OUTER JOIN external x ON x.namespace = i.namespace AND x.goal = i.goal"""),
    "prediction_json": statement(TYPED, BAYES, select="""
SELECT namespace, goal, CAST('0x' || substr(md5(event_name), 1, 1) AS BIGINT) AS part,
  '{"events":{' || string_agg('"' || event_name || '":{"bayes":'
    || CAST(round(bayes, 6) AS VARCHAR) || '}', ',' ORDER BY event_name) || '}}' AS document
FROM bayes GROUP BY namespace, goal, part"""),
    "nudges_user": statement(STEPS, BAYES, select="""
SELECT 'default' AS namespace, CAST(c_custkey AS VARCHAR) AS user_id, b.goal, b.event_name,
  round(b.bayes, 6) AS prediction,
  CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY b.bayes DESC, b.event_name)
       AS INT) AS rank
FROM customer, bayes b
WHERE b.namespace = 'default' AND b.goal = 'purchase'
  AND NOT EXISTS (SELECT 1 FROM named d WHERE d.namespace = 'default'
    AND d.user_id = CAST(c_custkey AS VARCHAR) AND d.event_name = b.event_name)"""),
    "nudges_all_users": statement(STEPS, BAYES, select="""
SELECT u.namespace, u.user_id, b.goal, b.event_name, round(b.bayes, 6) AS prediction,
  CAST(row_number() OVER (PARTITION BY u.namespace, u.user_id, b.goal
                          ORDER BY b.bayes DESC, b.event_name) AS INT) AS rank
FROM (SELECT DISTINCT namespace, user_id FROM log) u JOIN bayes b USING (namespace)
WHERE NOT EXISTS (SELECT 1 FROM named d WHERE d.namespace = u.namespace
  AND d.user_id = u.user_id AND d.event_name = b.event_name)"""),
    "combination_split": statement(TYPED, TAG_COUNTS, select="""
SELECT namespace, event_name, bucket, CAST(count(*) AS BIGINT) AS count
FROM (SELECT namespace, event_name,
        CASE WHEN list_contains(string_split(tags, '|'), 'error') THEN 'excluded'
             WHEN list_has_any(string_split(tags, '|'), ['view', 'click']) THEN 'included'
             ELSE 'ignored' END AS bucket
      FROM user_tags WHERE is_goal)
GROUP BY ALL"""),
    "events_ranked": statement(STEPS, select="""
SELECT namespace, event_name, counter_type, count,
  CAST(row_number() OVER (PARTITION BY namespace ORDER BY count DESC, event_name, counter_type)
       AS INT) AS rank
FROM totals"""),
    "goal_model_scores": statement(KEYED, select="""
SELECT DISTINCT CASE WHEN k < 50 THEN 'default' ELSE 'beta' END AS namespace,
  CASE WHEN event_type = 'purchase' THEN 'paid: purchase' ELSE event_type END AS event_name,
  CAST(event_type = 'purchase' AS DOUBLE) AS label, TRUE AS is_probability, TRUE AS told_apart
FROM k_events"""),
    "churn_combinations": statement(
        STEP_LOG.replace("log AS (", "base AS ("), CHURNED, FACTS_WITHOUT_WEEKS,
        """goals AS (SELECT DISTINCT namespace, 'last-login-4-weeks' AS goal_name,
          CAST(pow(2, 62) AS BIGINT) AS active_from_seq FROM log WHERE ensure_goal)""",
        MARKED, PRIOR, TAG_COUNTS, select="""
SELECT namespace, event_name, tags, count FROM tag_counts
WHERE event_name = 'last-login-4-weeks' AND depth > 0"""),
    "probability_matrix": statement(TYPED, BAYES, select="""
SELECT namespace, goal, """ + ",\n  ".join(
        f"round(max(bayes) FILTER (event_name = '{e}'), 6) AS {e}"
        for e in ("click", "error", "purchase", "signup", "view")) + """
FROM bayes GROUP BY namespace, goal"""),
    "funnel_depth": statement(STEPS, TAG_COUNTS, select="""
SELECT namespace, event_name, CAST(depth AS INT) AS depth, count(*) AS users
FROM user_tags WHERE is_goal GROUP BY ALL"""),
    "goal_event_share": statement(STEPS, select="""
SELECT s.namespace, s.event_name AS goal, s.tag, round(s.count / t.count, 6) AS share
FROM singles s JOIN totals t ON t.namespace = s.namespace AND t.event_name = s.event_name
  AND t.counter_type = 'named'
WHERE s.counter_type = 'named'"""),
    "churn_last_seen": statement(TYPED_LOG, select="""
SELECT namespace, 'last-login-4-weeks' AS event_name, user_id, TRUE AS ensure_goal
FROM log GROUP BY namespace, user_id
HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-26') >= 28"""),
    "churn_predictions": statement(
        STEP_LOG.replace("\nlog AS (", "\nbase AS ("), CHURNED, FACTS_WITHOUT_WEEKS,
        STREAM_GOALS, MARKED, PRIOR, TOTALS, SINGLES, BAYES, select="""
SELECT namespace, goal, event_name, round(bayes, 6) AS bayes FROM bayes"""),
}
