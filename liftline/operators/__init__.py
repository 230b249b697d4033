"""Operators: functions from DataFrames to DataFrames, one lazy plan each."""
