"""Common table expressions the statements are assembled from."""

from __future__ import annotations

KEYED = "k_events AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def log(name: str = "event_type", ts: str = "ts") -> str:
    return f"""{KEYED},
log AS (
  SELECT event_id AS seq, CASE WHEN k < 50 THEN 'default' ELSE 'beta' END AS namespace,
         {name} AS event_name, CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN k BETWEEN 40 AND 59 THEN NULL ELSE value END AS value,
         event_type = 'purchase' AND value > 100 AS ensure_goal,
         CAST(isoyear({ts}) AS INT) AS iso_year, CAST(week({ts}) AS INT) AS iso_week,
         {ts} AS ts
  FROM k_events)"""


TYPED_LOG = log()
STEP = ("CASE WHEN event_type IN ('purchase', 'signup') THEN event_type "
        "ELSE event_type || ' ' || CAST(k // 10 AS VARCHAR) END")
STEP_LOG = log(STEP)

FACTS = """named AS (
  SELECT namespace, event_name, 'named' AS counter_type, CAST(NULL AS INT) AS iso_year,
         CAST(NULL AS INT) AS iso_week, user_id, seq, value
  FROM log QUALIFY row_number() OVER (PARTITION BY namespace, event_name, user_id
                                      ORDER BY seq) = 1),
internal AS (
  SELECT namespace, 'global_counter' AS event_name, 'internal' AS counter_type,
         CAST(NULL AS INT) AS iso_year, CAST(NULL AS INT) AS iso_week, user_id, seq, value
  FROM log QUALIFY row_number() OVER (PARTITION BY namespace, user_id ORDER BY seq) = 1),
weekly AS (
  SELECT namespace, event_name, 'weekly' AS counter_type, iso_year, iso_week, user_id, seq,
         value
  FROM log WHERE event_name IN ('purchase', 'signup')
  QUALIFY row_number() OVER (PARTITION BY namespace, event_name, iso_year, iso_week, user_id
                             ORDER BY seq) = 1),
facts AS (SELECT * FROM named UNION ALL SELECT * FROM internal UNION ALL SELECT * FROM weekly)"""
FACTS_WITHOUT_WEEKS = FACTS.replace("UNION ALL SELECT * FROM weekly", "")

FIXED_GOALS = """goals(namespace, goal_name, active_from_seq) AS (
  VALUES ('default', 'purchase', 0), ('default', 'signup', 0), ('beta', 'purchase', 0))"""
STREAM_GOALS = """goals AS (
  SELECT namespace, event_name AS goal_name, min(seq) AS active_from_seq
  FROM log WHERE ensure_goal GROUP BY ALL)"""

MARKED = """marked AS (
  SELECT f.*, coalesce(f.counter_type <> 'internal' AND f.seq >= g.active_from_seq, FALSE)
                AS is_goal
  FROM facts f LEFT JOIN goals g
    ON g.namespace = f.namespace AND g.goal_name = f.event_name)"""

# Everything the user did before; the weekly write follows the event's own named write.
PRIOR = """prior AS (
  SELECT DISTINCT m.namespace, m.event_name, m.counter_type, m.iso_year, m.iso_week,
         m.user_id, m.seq AS goal_seq, l.event_name AS tag
  FROM marked m JOIN log l ON l.namespace = m.namespace AND l.user_id = m.user_id
   AND (l.seq < m.seq OR (m.counter_type = 'weekly' AND l.seq = m.seq))
   AND (m.counter_type = 'weekly' OR l.event_name <> m.event_name)
  WHERE m.is_goal)"""

KEY = "namespace, event_name, counter_type, iso_year, iso_week"

TOTALS = f"""totals AS (
  SELECT {KEY}, count(*) AS count, sum(value) AS value_sum FROM marked GROUP BY ALL)"""
SINGLES = f"""singles AS (SELECT {KEY}, tag, count(*) AS count FROM prior GROUP BY ALL)"""
TAG_COUNTS = f"""user_tags AS (
  SELECT m.namespace, m.event_name, m.counter_type, m.iso_year, m.iso_week, m.user_id,
         m.is_goal, coalesce(string_agg(p.tag, '|' ORDER BY p.tag), '') AS tags,
         count(p.tag) AS depth
  FROM marked m LEFT JOIN prior p ON p.namespace = m.namespace
   AND p.event_name = m.event_name AND p.counter_type = m.counter_type
   AND p.iso_year IS NOT DISTINCT FROM m.iso_year
   AND p.iso_week IS NOT DISTINCT FROM m.iso_week AND p.user_id = m.user_id
  GROUP BY ALL),
tag_counts AS (SELECT {KEY}, tags, depth, count(*) AS count FROM user_tags GROUP BY ALL)"""

BAYES = """bayes AS (
  SELECT s.namespace, s.event_name AS goal, s.tag AS event_name,
         (s.count / g.count) * (g.count / a.count) / (t.count / a.count) AS bayes
  FROM singles s
  JOIN totals g ON g.namespace = s.namespace AND g.event_name = s.event_name
               AND g.counter_type = 'named'
  JOIN totals t ON t.namespace = s.namespace AND t.event_name = s.tag
               AND t.counter_type = 'named'
  JOIN totals a ON a.namespace = s.namespace AND a.counter_type = 'internal'
  WHERE s.counter_type = 'named')"""

RATIOS = """evidence AS (
  SELECT DISTINCT namespace, event_name AS goal FROM singles WHERE counter_type = 'named'),
ratios AS (
  SELECT e.namespace, e.goal, t.event_name, coalesce(s.count, 0) / g.count AS yes_ratio,
         (t.count - coalesce(s.count, 0)) / g.count AS no_ratio
  FROM evidence e
  JOIN totals g ON g.namespace = e.namespace AND g.event_name = e.goal
               AND g.counter_type = 'named'
  JOIN totals t ON t.namespace = e.namespace AND t.counter_type = 'named'
  LEFT JOIN singles s ON s.namespace = e.namespace AND s.event_name = e.goal
               AND s.tag = t.event_name AND s.counter_type = 'named')"""


def counted(base_log: str, goals: str = FIXED_GOALS, weeks: bool = True) -> str:
    """From the log to totals, prior events and single tag counts."""
    facts = FACTS if weeks else FACTS_WITHOUT_WEEKS
    return ",\n".join([base_log, facts, goals, MARKED, PRIOR, TOTALS, SINGLES])


def statement(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()


def rounded(expression: str) -> str:
    """Six digits, by way of ten, like the Spark side."""
    return f"round(round({expression}, 10), 6)"
