"""Operators: functions from DataFrames to DataFrames, for many recordings (file_id) at once."""
