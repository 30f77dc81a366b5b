"""DataFrame operators: functions of DataFrames and column names."""
