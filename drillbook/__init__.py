"""Training-activity analytics as PySpark jobs.

Every operator takes DataFrames and plain parameters and returns DataFrames.
Clocks, seeds and time zones are always parameters.
"""
