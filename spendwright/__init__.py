"""Spark-native cost, experiment and causal analytics.

Every operator takes DataFrames plus parameters and returns a DataFrame, so
operators compose into one logical plan and run on whatever Spark session
built their inputs.
"""
