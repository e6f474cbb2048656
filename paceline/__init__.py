"""paceline: season-long competition analytics as plain Spark jobs.

Operators take DataFrames and return DataFrames.  Dates and seasons a query
runs "as of" are always arguments; nothing reads the clock.
"""
