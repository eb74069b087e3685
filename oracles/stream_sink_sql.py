"""SQL for streams (their batch equivalents), snapshots, metrics, documents."""

from __future__ import annotations

from oracles.analysis_sql import ANALYSIS, TYPED, TYPED_WEEKLY
from oracles.event_sql import EVENTS, SPECS
from oracles.flag_sql import FLAGS
from oracles.parts import (BAYES, FACTS, FIXED_GOALS, KEY, MARKED, STREAM_GOALS,
                           TAG_COUNTS, TOTALS, TYPED_LOG, counted, log, statement)

STREAMED_FACTS = statement(TYPED_WEEKLY, TAG_COUNTS, select="""
SELECT m.namespace, m.event_name, m.counter_type, m.iso_year, m.iso_week, m.user_id, m.seq,
  round(m.value, 6) AS value, m.is_goal, u.tags
FROM marked m JOIN user_tags u ON u.namespace = m.namespace AND u.event_name = m.event_name
  AND u.counter_type = m.counter_type AND u.user_id = m.user_id
  AND u.iso_year IS NOT DISTINCT FROM m.iso_year
  AND u.iso_week IS NOT DISTINCT FROM m.iso_week""")

COUNTER_ROWS = statement(TYPED_LOG, FACTS, FIXED_GOALS, MARKED, TOTALS, select=f"""
SELECT {KEY}, count, round(value_sum, 6) AS value_sum FROM totals""")


def _weekly_counts(base: str) -> str:
    return statement(base, select="""
SELECT namespace, event_name, iso_year, iso_week, count(DISTINCT user_id) AS count
FROM log GROUP BY ALL""")


SAME_KEY = """c.namespace = t.namespace AND c.event_name = t.event_name
  AND c.counter_type = t.counter_type AND c.iso_year IS NOT DISTINCT FROM t.iso_year
  AND c.iso_week IS NOT DISTINCT FROM t.iso_week"""

STREAMS_AND_SINKS: dict[str, str] = {
    "stream_first_writes": STREAMED_FACTS,
    "stream_unique_users": EVENTS["unique_users_by_event"],
    "stream_weekly": _weekly_counts(TYPED_LOG),
    "stream_late_events": _weekly_counts(log(ts="(ts - to_days(k))")),
    "stream_snapshot": COUNTER_ROWS,
    "stream_restart": STREAMED_FACTS,
    "stream_goal_activation": statement(counted(TYPED_LOG, STREAM_GOALS), select="""
SELECT t.*, c.tag, coalesce(c.count, 0) AS count
FROM (SELECT namespace, event_name, counter_type, iso_year, iso_week, count(*) AS goal_users
      FROM marked WHERE is_goal GROUP BY ALL) t
LEFT JOIN singles c ON """ + SAME_KEY),
    "stream_forward": statement(TYPED_LOG, select="""
SELECT namespace, event_name AS name, user_id AS key, count(*) AS events FROM log
GROUP BY ALL"""),
    "stream_predictions": ANALYSIS["bayes_predictions"],
    "stream_flags": FLAGS["flags_for_users"],
    "snapshot_roundtrip": COUNTER_ROWS,
    "snapshot_changes": COUNTER_ROWS,
    "facts_roundtrip": EVENTS["first_writes"],
    "registry_roundtrip": statement(TYPED_LOG, FACTS, STREAM_GOALS, MARKED, TOTALS, select="""
SELECT namespace, event_name, counter_type, iso_year, iso_week,
  counter_type <> 'internal' AND (namespace, event_name) IN
    (SELECT (namespace, goal_name) FROM goals) AS is_goal
FROM totals"""),
    "flag_spec_roundtrip": statement(SPECS, select="""
SELECT name, boolean, rollout_start, rollout_end, conditions FROM specs
WHERE reason IS NULL"""),
    "metrics_counters": statement(TYPED_LOG, FACTS, FIXED_GOALS, MARKED, TOTALS, select="""
SELECT CASE WHEN counter_type = 'weekly' THEN 'event_counter_weekly' ELSE 'event_counter' END
    AS metric, namespace, event_name AS name, CAST(iso_year AS VARCHAR) AS year,
  CAST(iso_week AS VARCHAR) AS week, CAST(count AS DOUBLE) AS value
FROM totals"""),
    "metrics_predictions": statement(TYPED, BAYES, select="""
SELECT 'goal_prediction' AS metric, namespace, goal, event_name AS event,
  round(bayes, 6) AS value
FROM bayes"""),
    "analytics_json": statement(TYPED_WEEKLY, TAG_COUNTS, """sets AS (
  SELECT namespace, event_name, counter_type, iso_year, iso_week,
    CAST('0x' || substr(md5(tags), 1, 1) AS BIGINT) AS part,
    string_agg('{"events":[' || CASE WHEN tags = '' THEN '' ELSE '"'
      || replace(tags, '|', '","') || '"' END || '],"count":' || CAST(count AS VARCHAR)
      || '}', ',' ORDER BY string_split(tags, '|')) AS event_counts
  FROM tag_counts GROUP BY ALL)""", """ones AS (
  SELECT namespace, event_name, counter_type, iso_year, iso_week,
    CAST('0x' || substr(md5(tag), 1, 1) AS BIGINT) AS part,
    string_agg('{"name":"' || tag || '","count":' || CAST(count AS VARCHAR) || '}', ','
               ORDER BY tag) AS single_event_counts
  FROM singles GROUP BY ALL)""", """parts AS (
  SELECT coalesce(s.namespace, o.namespace) AS namespace,
    coalesce(s.event_name, o.event_name) AS event_name,
    coalesce(s.counter_type, o.counter_type) AS counter_type,
    coalesce(s.iso_year, o.iso_year) AS iso_year, coalesce(s.iso_week, o.iso_week) AS iso_week,
    coalesce(s.part, o.part) AS part, coalesce(event_counts, '') AS event_counts,
    coalesce(single_event_counts, '') AS single_event_counts
  FROM sets s FULL JOIN ones o ON o.namespace = s.namespace AND o.event_name = s.event_name
    AND o.counter_type = s.counter_type AND o.iso_year IS NOT DISTINCT FROM s.iso_year
    AND o.iso_week IS NOT DISTINCT FROM s.iso_week AND o.part = s.part)""", f"""named_totals AS (
  SELECT *, CASE WHEN counter_type = 'weekly'
      THEN event_name || ' ' || CAST(iso_year AS VARCHAR) || CAST(iso_week AS VARCHAR)
      ELSE event_name END AS name FROM totals)""", select=f"""
SELECT t.namespace, t.name, s.part, '{{"name":"' || t.name || '","type":"' || t.counter_type
  || '","count":' || CAST(t.count AS VARCHAR) || ',"event_counts":[' || s.event_counts
  || '],"single_event_counts":[' || s.single_event_counts || '],"value":{{'
  || CASE WHEN t.value_sum IS NULL THEN '' ELSE '"sum":'
       || CAST(CAST(round(t.value_sum) AS BIGINT) AS VARCHAR) END || '}}}}' AS document
FROM named_totals t
JOIN parts s ON {SAME_KEY.replace('c.', 's.')}"""),
}
