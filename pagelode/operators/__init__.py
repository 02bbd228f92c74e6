"""Operators: functions from DataFrame to DataFrame with column parameters."""
