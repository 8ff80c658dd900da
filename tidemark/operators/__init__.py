"""Operators: functions from DataFrames to DataFrames over timed text.

Segments have recording_id, ord, start_s, end_s, text; order is (start_s, ord) within a recording unless said otherwise.
"""
