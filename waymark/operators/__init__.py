"""Batch operators: functions from DataFrames to DataFrames."""
