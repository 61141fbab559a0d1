"""tideline: market analytics and state-space filtering on Spark DataFrames."""

__version__ = "0.1.0"
