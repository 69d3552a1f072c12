"""tarnwork: a PySpark-native analytics engine for job-queue tables.

Every operator is a lazy function from DataFrames to a DataFrame; ``now`` is
always a parameter, never the wall clock.
"""

__version__ = "0.1.0"
