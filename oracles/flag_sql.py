"""SQL for feature flags."""

from __future__ import annotations

from oracles.event_sql import SPECS
from oracles.parts import statement

NOW = "1704585600"
USERS = """users AS (
  SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS n,
    CASE WHEN c_nationkey > 4 THEN c_nationkey END AS nation,
    (c_custkey * 7919 % 1000) / 1000.0 AS rand
  FROM customer)"""
NATIONS = f"""nations AS (
  SELECT n_nationkey AS n, n_name AS name, n_regionkey = 0 AS boolean,
    CASE WHEN n_regionkey > 1 THEN {NOW} - 86400 * (n_nationkey - 10) END AS s,
    CASE WHEN n_regionkey > 2 THEN {NOW} - 86400 * (n_nationkey - 10) + 86400 * n_nationkey
      END AS e
  FROM nation)"""


def _rollout(start: str, end: str) -> str:
    return (f"CASE WHEN {start} IS NULL OR {end} IS NULL THEN FALSE "
            f"WHEN {NOW} <= {start} THEN FALSE WHEN {NOW} >= {end} THEN TRUE "
            f"ELSE rand <= ({NOW} - {start}) / ({end} - {start}) END")


FLAGS: dict[str, str] = {
    "flag_boolean": statement(SPECS, select="""
SELECT p_partkey, boolean AS enabled FROM specs WHERE reason IS NULL"""),
    "flag_user_eq": statement(USERS, select="""
SELECT c_custkey, segment = 'BUILDING' AS segment_is, coalesce(nation = 7, FALSE) AS nation_is,
  coalesce(nation = 7, FALSE) AS nation_is_decimal, FALSE AS nation_is_text,
  FALSE AS absent_is FROM users"""),
    "flag_user_in": statement(USERS, select="""
SELECT c_custkey, coalesce(nation BETWEEN 5 AND 7, FALSE) AS nation_in,
  FALSE AS nation_in_texts, c_custkey BETWEEN 40 AND 42 AS text_in,
  segment IN ('BUILDING', 'MACHINERY') AS segment_in FROM users"""),
    "flag_user_or": statement(USERS, select="""
SELECT c_custkey, segment = 'BUILDING' OR coalesce(nation IN (8, 9), FALSE) AS enabled
FROM users"""),
    "flag_rollout": statement(USERS, f"""bounds AS (
  SELECT c_custkey, rand, {NOW} + CAST(floor(balance) AS BIGINT) - 4000 AS s,
    CASE WHEN n <> 0 THEN {NOW} + CAST(floor(balance) AS BIGINT) - 4000 + 100 * n END AS e
  FROM users)""", select=f"""
SELECT c_custkey, {_rollout('s', 'e')} AS enabled FROM bounds"""),
    "flag_precedence": statement(USERS, f"""bounds AS (
  SELECT *, CASE WHEN n < 20 THEN {NOW} - 86400 * (n - 10) END AS s,
    CASE WHEN n < 18 THEN {NOW} - 86400 * (n - 10) + 5 * 86400 END AS e FROM users)""",
                                 select=f"""
SELECT c_custkey, n < 3 OR segment = 'BUILDING' OR {_rollout('s', 'e')} AS enabled
FROM bounds"""),
    "flags_for_users": statement(USERS, NATIONS, select=f"""
SELECT c_custkey, f.name, f.boolean OR coalesce(u.nation = f.n, FALSE)
  OR {_rollout('f.s', 'f.e')} AS enabled
FROM users u, nations f"""),
    "flag_spec_rejects": """
SELECT p_partkey, reason FROM (
  SELECT p_partkey,
    CASE WHEN p_size % 6 = 0 THEN 'unknown_comparator'
         WHEN p_size % 5 = 0 THEN 'condition_needs_three_terms'
         WHEN p_size % 4 <> 0 AND p_size % 3 = 0 THEN 'rollout_without_end'
         WHEN p_size % 4 = 0 AND p_size % 3 <> 0 THEN 'rollout_without_start'
         WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 AND p_size > 20
           THEN 'rollout_ends_before_start' END AS reason
  FROM part) WHERE reason IS NOT NULL""",
    "flag_spec_upsert": """
SELECT 'flag ' || CAST(o_custkey AS VARCHAR) AS name, o_orderkey AS seq,
  o_orderstatus = 'F' AS boolean,
  CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS rollout_start
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "flag_bool_coerce": """
SELECT p_partkey,
  CASE p_size % 8 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 5 THEN NULL WHEN 6 THEN NULL
    ELSE FALSE END AS boolean,
  CASE WHEN p_size % 8 = 6 THEN CAST(7 AS BIGINT) END AS bound
FROM part""",
    "flag_spec_render": statement(SPECS, select="""
SELECT name, '{"name":"' || name || '","boolean":' || CAST(boolean AS VARCHAR)
  || ',"rollout_start":"' || strftime(make_timestamp(rollout_start * 1000000),
                                      '%Y-%m-%dT%H:%M:%SZ') || '"'
  || CASE WHEN rollout_end IS NULL THEN '' ELSE ',"rollout_end":"'
       || strftime(make_timestamp(rollout_end * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '"' END
  || ',"user":[{"property":"brand","comparator":"=","value":"' || p_brand
  || '"},{"property":"size","comparator":"in","value":[' || CAST(s AS VARCHAR) || ','
  || CAST(s + 1 AS VARCHAR) || ']}]}' AS document
FROM specs WHERE reason IS NULL"""),
    "flag_spec_list": """
SELECT name, CAST(row_number() OVER (PARTITION BY lower(name[1]) ORDER BY lower(name), name)
                 AS INT) AS rank
FROM (SELECT CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE p_name END || ' '
        || CAST(p_partkey AS VARCHAR) AS name FROM part)""",
    "rollout_exposure": f"""
SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
  CAST({NOW} + 86400 * (p_size + step) AS BIGINT) AS at, round(step / 10, 6) AS chance
FROM part, range(0, 11) r(step)""",
}
