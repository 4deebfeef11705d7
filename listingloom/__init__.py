"""Event-listing analytics on Spark: functions from DataFrames to DataFrames."""
