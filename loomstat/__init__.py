"""Spark-native tabular regression analytics.

Topic tables that share one entity key are cleaned, combined, profiled,
turned into feature vectors, fitted with several regressor families,
evaluated, explained and re-applied to another cycle of the same tables.
"""

__version__ = "0.1.0"
