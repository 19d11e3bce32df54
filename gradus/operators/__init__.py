"""Operators: functions from DataFrames (and fitted parameters) to DataFrames."""
