"""Waymark: user-event analytics as PySpark DataFrame jobs.

Raw events become an ordered event log; the log becomes first-write facts (one row per
counter and user); every count, goal funnel, prediction and nudge is an aggregation over
those facts. Feature flags are column expressions evaluated over user tables.
"""
